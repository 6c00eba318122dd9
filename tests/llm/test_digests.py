"""The columns of the registered queries of ops 4, 9 and 10 on the small table, against plain Python."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
import tokenizers
import xxhash

from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op4_columns(spark, texts):
    rows = QUERIES["op4_flac"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] > 0 and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["feature"]
        assert by_text.setdefault(data, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op10_columns(spark, texts):
    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    rows = QUERIES["op10_bpe"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = own.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op9_columns(spark, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
        if not words:
            return 0
        hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3 and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    rows = QUERIES["op9_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    assert len(rows) == len(ids)
