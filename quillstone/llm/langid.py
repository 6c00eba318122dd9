"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and for every single byte, so that any
word can be cut). A word's probability is the sum over all its segmentations into pieces of the product of their
probabilities: a forward pass over the word's bytes. The probabilities are fitted by expectation-maximisation over the
same segmentations. numpy runs the pass for thousands of words and all languages at once, walking a trie of the pieces.

The model is fitted from a bounded sample of labelled rows (about `max_rows` of each language, those of the lowest 64-bit
hashes of id and text), which reaches the driver as word counts. Whole texts are scored; words are runs of letters, lower-cased.

Defined cases: a text that is null or has no letter is `und` with score 0; rows without a language teach nothing; with no
row to learn from every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import below_share

LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Bound on the labelled rows that the fit uses.
MAX_ROWS = 1000
#: Words whose log-probabilities a worker keeps.
CACHE_WORDS = 200_000
_TINY = 1e-120


class Trie:
    """Pieces by their bytes. next[node * width + symbol] is the node after one more byte; symbols number the bytes in use."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        nodes: list[dict[int, int]] = [{}]
        piece_of = [-1]
        for i, piece in enumerate(pieces):
            at = 0
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    piece_of.append(-1)
                at = nodes[at][byte]
            piece_of[at] = i
        self.longest = max(map(len, pieces))
        self.next = np.zeros((len(nodes), 256), np.int32) if len(nodes) < 1 << 16 else None
        if self.next is None:
            keys = np.array([n << 8 | b for n, d in enumerate(nodes) for b in d], np.int64)
            order = np.argsort(keys)
            self.keys, self.values = keys[order], np.array([v for d in nodes for v in d.values()], np.int32)[order]
        else:
            for n, d in enumerate(nodes):
                for b, v in d.items():
                    self.next[n, b] = v
        self.piece_of = np.array(piece_of, np.int32)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """0 where no piece goes on."""
        if self.next is not None:
            return self.next[node, byte]
        key = node.astype(np.int64) << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], 0)


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, None] = {bytes([b]): None for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            found[model.id_to_piece(i).lower().encode()] = None
    return Trie(list(found))


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def _padded(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in group], np.int64)
    out = np.zeros((len(group), int(size.max())), np.uint8)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer(b"".join(group), np.uint8)
    return out, size


def _walk(t: Trie, data: np.ndarray, size: np.ndarray, s: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(end, rows, pieces) of the pieces that begin at byte s, shortest first."""
    rows = np.flatnonzero(size > s)
    node = np.zeros(len(rows), np.int32)
    for e in range(s + 1, min(s + t.longest, data.shape[1]) + 1):
        node = t.step(node, data[rows, e - 1])
        go = (node > 0) & (size[rows] >= e)
        rows, node = rows[go], node[go]
        if not len(rows):
            return
        piece = t.piece_of[node]
        hit = piece >= 0
        if hit.any():
            yield e, rows[hit], piece[hit]


def _groups(words: list[str], cells: int = 1 << 19) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Words of about one length together, so that padding is little and memory bounded."""
    data = [(START + w).encode() for w in words]
    order = np.argsort([len(d) for d in data], kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * len(data[order[at + n]]) <= cells and len(data[order[at + n]]) <= len(data[order[at]]) + 2:
            n += 1
        pick = order[at : at + n]
        yield pick, [data[i] for i in pick]
        at += n


def _forward(t: Trie, probs: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha (positions, rows, languages) and the natural logarithm to add to it, by position: tiny values are scaled up."""
    n, width = data.shape
    alpha = np.zeros((width + 1, n, probs.shape[1]))
    alpha[0] = 1.0
    added = np.zeros((width + 1, n, probs.shape[1]))
    for s in range(width):
        if s and s % 16 == 0:
            low = (alpha[s] < _TINY) & (alpha[s] > 0)
            if low.any():
                ahead = slice(s, min(s + t.longest, width) + 1)
                alpha[ahead] = np.where(low[None], alpha[ahead] / _TINY, alpha[ahead])
                added[s:] += np.where(low, np.log(_TINY), 0.0)[None]
        here = alpha[s]
        for e, rows, piece in _walk(t, data, size, s):
            alpha[e, rows] += here[rows] * probs[piece]
    return alpha, added


def log_probabilities(t: Trie, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages) natural logarithms of the words' marginal probabilities."""
    out = np.zeros((len(words), probs.shape[1]))
    for pick, group in _groups(words):
        data, size = _padded(group)
        alpha, added = _forward(t, probs, data, size)
        rows = np.arange(len(size))
        out[pick] = np.log(np.maximum(alpha[size, rows], 1e-300)) + added[size, rows]
    return out


def _expected(t: Trie, probs: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words, each taken counts times."""
    out = np.zeros(t.size)
    p = probs[:, None]
    for pick, group in _groups(words):
        data, size = _padded(group)
        alpha, added = _forward(t, p, data, size)
        rows = np.arange(len(size))
        log_z = np.log(np.maximum(alpha[size, rows, 0], 1e-300)) + added[size, rows, 0]
        beta, scale = np.zeros((data.shape[1] + 1, len(size))), np.zeros(len(size))  # true values: beta times e^scale
        beta[size, rows] = 1.0
        for s in range(data.shape[1] - 1, -1, -1):
            weight = counts[pick] * np.exp(np.minimum(added[s, :, 0] + scale - log_z, 700.0))
            for e, r, piece in _walk(t, data, size, s):
                use = probs[piece] * beta[e, r]
                beta[s, r] += use
                out += np.bincount(piece, use * alpha[s, r, 0] * weight[r], t.size)
            if s % 16 == 0 and (low := (beta[s] < _TINY) & (beta[s] > 0)).any():
                ahead = slice(s, min(s + t.longest, data.shape[1]) + 1)
                beta[ahead] = np.where(low[None], beta[ahead] / _TINY, beta[ahead])
                scale += np.where(low, np.log(_TINY), 0.0)
    return out


def fit_counts(t: Trie, counts: dict[str, Counter], rounds: int = 3, smoothing: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and (pieces, languages) probabilities from word counts of each language."""
    languages = sorted(counts)
    probs = np.zeros((t.size, len(languages)))
    for j, language in enumerate(languages):
        found = sorted(counts[language].items())
        n = np.array([c for _, c in found], float)
        p = np.full(t.size, 1.0 / t.size)
        for _ in range(rounds):
            expected = _expected(t, p, [w for w, _ in found], n) + smoothing
            p = expected / expected.sum()
        probs[:, j] = p
    return languages, probs


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Fit on about max_rows rows of each language at most, those with the lowest hashes of id and text. Rows of equal id and
    text teach once. A language with rows to learn from is always learned: the share of its rows has no lower end."""
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("key")
    )
    # Different rows are counted, by a sketch of a fixed size: copies must not thin out what there is to learn from.
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}  # one row a language
    if any(n > max_rows for n in totals.values()):
        shares = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, max_rows / n))))
        known = known.where(below_share(F.col("key"), F.element_at(shares, F.col("lang"))))
    known = known.dropDuplicates(["lang", "key"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    found = known.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    for r in found.toLocalIterator():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    return fit_counts(trie(vocabulary), counts)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, n_words) of each row's whole text. The score is the posterior of the predicted language
    under a uniform prior, with the log-likelihood divided by the root of the number of words (words are not
    independent, and a product over thousands of them would always be certain)."""
    languages, probs = model
    shared = docs.sparkSession.sparkContext.broadcast(probs)  # vocabulary x languages: a fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, p = trie(vocabulary), shared.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(languages)))
        for batch in it:
            found = [words_of(x) for x in batch.column(1).to_pylist()] if languages else [[]] * batch.num_rows
            new = list(dict.fromkeys(w for ws in found for w in ws if w not in known))
            if len(known) + len(new) > CACHE_WORDS:
                known, table = {}, np.zeros((0, len(languages)))
                new = list(dict.fromkeys(w for ws in found for w in ws))
            if new:
                known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                table = np.concatenate([table, log_probabilities(t, p, new)])
            pred, score = [], []
            for ws in found:
                if not ws:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = table[[known[w] for w in ws]].sum(axis=0)
                best = int(total.argmax())
                pred.append(languages[best])
                score.append(float(1 / np.exp((total - total[best]) / np.sqrt(len(ws))).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([len(ws) for ws in found], pa.int64())],
                ["id", "lang_pred", "score", "n_words"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, n_words long").withColumnRenamed("id", id_col)
