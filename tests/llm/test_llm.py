"""The ten operators and the pipeline against brute force, on small inputs with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import bpe, bwt, flac, langid, lines, lm, packing, quality, queries, repeats, simhash, topk
from quillstone.llm.common import crc_mod, ship, words

JSON = public_tokenizers.path("byte_bpe_50k.json")
PASSAGE = " ".join(f"shared{i} passage{i % 7}" for i in range(40))
R = random.Random(3)
TEXTS = [
    None, "", " ", "\n\n", "one", "Two words", PASSAGE, f"a lead {PASSAGE} and a tail", f"other start {PASSAGE}", "ab" * 400, "é" * 300, "the the the",
    *(" ".join(R.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(R.randrange(5, 60))) for _ in range(25)),
    "\n".join(" ".join(f"w{i}x{j}" for i in range(12)) for j in range(4)), "\n".join(" ".join(f"w{i}x{j}" for i in range(11)) + " new" for j in range(4)), "x" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", i) for i, t in enumerate(TEXTS)] + [(None, "null id text", "en", "s", 1), (3, "same id", None, "s", 2), (20, TEXTS[20], "en", "s", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, rank int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe_equals_library(docs):
    t = Tokenizer.from_file(JSON)
    e = bpe.encoder(JSON)
    odd = ["<|endoftext|> a", "  b\n \nc", "I'm 3rd\t é", "🙂 zwj 👨‍👩‍👧", "a" * 3000, "\x85\xa0 　x", *(x or "" for x in TEXTS)]
    for x in odd + ["".join(R.choice("ab '\n\té1.?") for _ in range(30)) for _ in range(300)]:
        want = t.encode(x, add_special_tokens=False).ids
        got = np.frombuffer(e.encode_packed(x), np.uint32)
        assert got.tolist() == want
        assert e.decode(got) == t.decode(want, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, JSON), JSON)
    assert collections.Counter(r["text"] for r in back.collect()) == collections.Counter(r["text"] or "" for r in docs.collect())


def test_packing(docs, empty):
    t = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, size=64).collect()
    assert packing.pack(empty, JSON).count() == 0
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter()
    for d in docs.collect():
        ids = [*t.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            part = np.array(ids[a : a + 64], "<u4")
            want[d["doc_id"], a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want


@pytest.mark.parametrize("lengths", [R.choices(range(300, 1200), k=4000), R.choices(range(700, 1100), k=999), [1025] * 50, list(range(1, 60)), []])
def test_cutting_stock(lengths):
    counts = np.bincount(lengths, minlength=2049) if lengths else np.zeros(2049, int)
    plan = packing.solve(counts, 2048)
    used = np.zeros(2049, int)
    for pattern, n in plan.patterns:
        assert pattern.sum() <= 2048
        np.add.at(used, pattern, n)
    assert (used == counts).all()
    assert plan.bound <= sum(n for _, n in plan.patterns) + 1e-6


def test_columns_are_priced_on_real_lengths():
    """On the given documents the plan comes from priced patterns, at the linear program's optimum, with little padding."""
    encode = packing.token_ids(JSON)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    counts = np.zeros(2049, np.int64)
    for n in (len(encode(t or "")) + 1 for t in texts):
        counts[2048] += n // 2048
        counts[n % 2048] += n % 2048 > 0
    for times in (1, 1000):
        plan = packing.solve(counts * times, 2048)
        total = sum(n for _, n in plan.patterns)
        assert plan.rounds > 50 and plan.entered > 200
        assert plan.from_patterns > 0.6 * total
        assert plan.bound <= total <= 1.003 * plan.bound + 1


def test_linear_program():
    """The simplex against the best of all vertices, on programs small enough to list all patterns."""
    for _ in range(20):
        size = R.randrange(6, 14)
        lengths = np.array(sorted(R.sample(range(2, size + 1), 3)))
        demand = np.array([R.randrange(1, 30) for _ in lengths], float)
        patterns = [p for p in itertools.product(*(range(size // x + 1) for x in lengths)) if 0 < np.dot(p, lengths) <= size]
        best = np.inf
        for three in itertools.combinations(patterns, 3):
            a = np.array(three, float).T
            if abs(np.linalg.det(a)) > 1e-9 and ((x := np.linalg.solve(a, demand)) >= -1e-9).all():
                best = min(best, x.sum())
        basis, x, _, _ = packing.generate(lengths, demand, size)
        assert np.allclose(basis @ x, demand) and x.sum() == pytest.approx(best)


def test_language_model(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    out = {r["doc_id"]: r for r in lm.score(rows, crc_mod("doc_id", 7) != 2).collect()}
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in rows.collect()}
    c = collections.Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in texts.items():
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert out[i]["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert out[i]["score"] < 0
    p = lm.Parameters.initial(np.ones(lm.CLASSES))
    first = np.zeros(2, np.int64)
    total = sum(np.exp(lm.log_probabilities(p, np.array([0, k]), np.array([0, 1])))[0] for k in range(lm.CLASSES))
    assert total == pytest.approx(1, abs=1e-4) and first is not None


def test_bwt_merge():
    for _ in range(60):
        d = R.choice([1, 2, 3, 5, 7, 20])
        strings = [bytes(R.choice(b"ab\0") for _ in range(R.randrange(1, 60))) for _ in range(R.randrange(1, 9))]
        c = collections.Counter(s[p : p + d] for s in strings for p in range(len(s) - d + 1))
        want = [[p for p in range(len(s) - d + 1) if c[s[p : p + d]] > 1] for s in strings]
        assert [a.tolist() for a in bwt.repeats(strings, d, shard_bytes=R.choice([10, 50, 1000]))] == want


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeats(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    assert repeats.digests(empty).count() == 0
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    c = collections.Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    want = collections.Counter()
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if c[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in repeats.digests(docs).collect()) == want


def test_flac(docs):
    data = [flac.payload(t) for t in TEXTS] + [bytes(R.randrange(256) for _ in range(576 * 3)), bytes(576 * 140), bytes((i * i // 50) % 256 for i in range(1152))]
    media = flac.encode(data)
    assert flac.decode(media) == data
    assert flac.decode(media, 576, 576)[-2] == data[-2][576:1152]
    broken = bytearray(media[-1])
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])
    blocks = flac.pcm_blocks(flac.to_media(docs), samples=1152).groupBy("doc_id").sum("n_samples").count()
    assert blocks == docs.select("doc_id").distinct().count()


def test_language_id(spark, docs):
    t = langid.trie(public_tokenizers.path("piece_bpe_32k.model"))
    small = langid.Trie([b"a", b"b", b"ab", langid.START.encode(), *(bytes([x]) for x in langid.START.encode())])
    p = np.full((small.size, 1), 0.1)
    # _ab: {_ or its three bytes} x {ab, a b}
    assert np.exp(langid.log_probabilities(small, p, ["ab"]))[0, 0] == pytest.approx((0.1 + 0.001) * (0.1 + 0.01))
    counts = {"x": collections.Counter({"lorem": 9, "ipsum": 5}), "y": collections.Counter({"kwaza": 8, "zulu": 7})}
    model = langid.fit_counts(t, counts)
    df = spark.createDataFrame([(1, "Lorem lorem"), (2, "zulu KWAZA"), (3, None), (4, "12 --"), (5, "")], "doc_id int, text string")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert [out[i][0] for i in range(1, 6)] == ["x", "y", "und", "und", "und"] and all(0 <= s <= 1 for _, s in out.values())
    long_word = langid.log_probabilities(t, model[1], ["q" * 4000])
    assert np.isfinite(long_word).all()


def test_lines(docs, empty):
    assert lines.dedup_lines(empty).count() == 0
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id")
    seen, want = [], {}
    for r in rows.collect():
        kept = []
        for line in (r["text"] or "").split("\n"):
            s = set(words(line))
            hit = len(s) >= 5 and any(len(s & o) >= 0.8 * len(s | o) for o in seen)
            if len(s) >= 5:
                seen.append(s)
            if not hit:
                kept.append(line)
        want[r["doc_id"]] = None if r["text"] is None else "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(rows).collect()}
    assert got == want


def test_simhash(docs, empty):
    assert simhash.near_duplicates(empty).count() == 0
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    w = words(TEXTS[20])
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r["fingerprint"] for r in out if r["doc_id"] == 20} == {f"{fp:016x}"}
    assert {r["component_id"] for r in out if r["doc_id"] in (0, 1, 2, 3) and r["fingerprint"] == "0" * 16} == {0}


@pytest.mark.parametrize("hot", [3, 2048])
def test_simhash_links(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SEGMENT", hot)
    base = [R.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << R.randrange(64) for _ in range(R.randrange(6))) & (1 << 64) - 1 for b in base for _ in range(25)}
    ints = sorted(fps)
    parent = list(range(len(ints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ints):
        for j in range(i):
            if (a ^ ints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    want = collections.Counter(frozenset(ints[i] for i in range(len(ints)) if find(i) == r) for r in {find(i) for i in range(len(ints))})
    signed = [x - (1 << 64) if x >> 63 else x for x in ints]
    roots = {r["fp"]: r["root"] for r in simhash._roots(spark.createDataFrame([(x,) for x in signed], "fp long"), 3).collect()}
    groups = collections.defaultdict(set)
    for x, s in zip(ints, signed, strict=True):
        groups[roots[s]].add(x)
    assert collections.Counter(map(frozenset, groups.values())) == want


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (None, rows[1][1]), (301, [float("nan"), None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in topk.search(df, df.where("vec_id % 50 = 0"), k=5, dim=16, width=8).collect()}
    code = {i: [bool(j < len(v) and v[j] is not None and v[j] > 0) for j in range(16)] for i, v in rows if i is not None and v is not None}
    for q in (i for i in code if i % 50 == 0):
        best = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, d) for d, i in best]


def test_quality(spark, docs):
    rows = [quality.Indicators()(t) for t in ["good plain words here"] * 8 + ["b@d $$$ %%% &&&"] * 8]
    m = quality.fit_rows(rows, np.array([1] * 8 + [0] * 8))
    s = m.score(np.array([m.margin(quality.Indicators()(t)) for t in ("plain good words", "%%% $$$", "")]))
    assert s[0] > 0.5 > s[1] and 0 <= s[2] <= 1
    assert quality.fit_rows([], np.zeros(0)).score(np.array([0.0]))[0] == pytest.approx(0.5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (4, None)], "doc_id long, quality int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.count() == docs.count() and out.columns == [*docs.columns, "score"]


def test_pipeline_keeps_columns(spark, docs, tmp_path):
    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        step = spark.read.parquet(f"{tmp_path}/{i}")
    assert step.count() > 0


def test_stages_on_empty(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in queries.QUERIES}
