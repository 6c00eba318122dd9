"""Byte-level BPE by backtracking over longest matches, and decoding through an offset table.

The encoder never runs merges. An Aho-Corasick automaton of the reversed tokens, run once over the reversed word, gives
the longest token at every position. Tokens are taken greedily; a token may follow another only if BPE would keep that
boundary, which the pair-compatibility test decides from the merge table. When no token fits at a position the position
is marked dead and the last token is shortened to its longest prefix that is a token. Each position dies at most once,
so a word is encoded in linear time, however long it is.

Null text is the empty text and has no ids. Rows are independent, so repeated rows and null ids need no care.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillstone.llm.common import texts_of

# The pre-token pattern of this public vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank between two white-space characters: only there is a blank no safe place to cut.
_ENTANGLED = regex.compile(r"\s \s")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b if b in plain else next(moved)) for b in range(256)]


class _ChunkCache(dict):
    """Chunk -> its ids as little-endian uint32 bytes, in two generations of bounded size."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class BacktrackingBPE:
    def __init__(self, path: str, cache_chunks: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.special:
                self.tokens[i] = bytes(to_byte[c] for c in token)
        self.rank = [-1] * size
        self.split: list[tuple[int, int]] = [(-1, -1)] * size
        self.pair: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[whole], self.split[whole], self.pair[left, right] = r, (left, right), r
        # A token counts only if BPE makes it from its own bytes: merges come in order, so its parts are known first.
        alive = [len(t) == 1 for t in self.tokens]
        for a, b in merges:
            whole = vocab[a + b]
            left, right = self.split[whole]
            alive[whole] = alive[left] and alive[right] and self._boundary_holds(left, right, self.rank[whole])
        self.length = [len(t) for t in self.tokens]
        ids = {t: i for i, t in enumerate(self.tokens) if t and alive[i]}
        self.shorter = [-1] * size
        automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            automaton.add_word(t[::-1].decode("latin-1"), i)
            for end in range(len(t) - 1, 0, -1):
                if (p := ids.get(t[:end])) is not None:
                    self.shorter[i] = p
                    break
        automaton.make_automaton()
        self.automaton = automaton
        self.whole = {t: np.uint32(i).tobytes() for t, i in ids.items()}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.decimal = [str(i) for i in range(size)]
        self.pretokens = regex.compile(PRETOKEN).findall
        self.stops = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.compatible = lru_cache(maxsize=1 << 18)(lambda a, b: self._boundary_holds(a, b, len(merges) + 1))
        self.chunks = _ChunkCache(self._encode_chunk, cache_chunks)

    def _boundary_holds(self, a: int, b: int, limit: int) -> bool:
        """Whether BPE leaves the boundary between a and b alone. The merges that made a and b are undone from the
        latest; no pair that then meets at the boundary may merge before the merge just undone."""
        rank, split, pair = self.rank, self.split, self.pair
        while True:
            if pair.get((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                a = split[a][1]
            elif rank[b] < 0:
                return True
            else:
                limit = rank[b] + 1  # an equal merge further left comes first
                b = split[b][0]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(word)
        if n == 0:
            return []
        longest = [-1] * n
        for end, token in self.automaton.iter(word[::-1].decode("latin-1")):
            if longest[at := n - 1 - end] < 0:  # of the matches that end here the longest comes first
                longest[at] = token
        length, shorter, compatible = self.length, self.shorter, self.compatible
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if alive[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= length[token]

    def _encode_chunk(self, chunk: str) -> bytes:
        out = []
        for piece in self.pretokens(chunk):
            word = piece.encode()
            ids = self.whole.get(word)
            out.append(ids if ids is not None else np.array(self.encode_word(word), np.uint32).tobytes())
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.stops is None or not (found := list(self.stops.finditer(text))):
            return self._encode_plain(text)
        out, at = [], 0
        for m in found:
            out += [self._encode_plain(text[at : m.start()]), np.uint32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _ENTANGLED.search(text):
            return b"".join(map(self.chunks.__getitem__, self.pretokens(text)))
        head, *rest = text.split(" ")
        parts = [self.chunks[head]] if head else []
        parts.extend(map(self.chunks.__getitem__, [" " + x for x in rest]))
        return b"".join(parts)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: each is a slice of one blob, found in the offset table."""
        start = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(start - (ends - size), size) + np.arange(total)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def encoder(path: str) -> BacktrackingBPE:
    """One encoder for each worker process and vocabulary file."""
    return BacktrackingBPE(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row's whole text. Null text: no ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in it:
            ids = [np.frombuffer(bpe.encode_packed(t), np.uint32).astype(np.int32) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids). Null ids: empty text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in it:
            texts = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: encode and decode in one pass, so the ids, which are
    larger than the texts, never leave the worker."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        decimal = bpe.decimal.__getitem__
        for batch in it:
            n, ids_sha, text_sha = [], [], []
            for text in texts_of(batch.column(1)):
                ids = np.frombuffer(bpe.encode_packed(text), np.uint32)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
