"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Words are the tokens; each text ends with one end token. Every word belongs to one of a fixed number of classes: the
most frequent words have a class of their own, other words share the class of their ending. The model predicts the
class of the next token from the classes before it; inside a class a word has its add-one share, so

    P(word | context) = softmax(context vector . class vectors + bias)[class] * (c + 1) / (T + V + 1)

with c the word's training count, and T and V the tokens and distinct words of its class in training. Each class keeps
one place for words never seen, so the probabilities of all words and the unseen place sum to one in every context.

The context vector is log-bilinear: position weights times the vectors of the nearest tokens, plus a matrix times the
mean vector of a longer history of the same text. Training is noise-contrastive in numpy: each task goes through its
own training texts, and the tasks' parameters are averaged, weighted by tokens, between rounds. Scoring computes the
normalised log-probabilities by batched matrix products.

Counts cover the whole training corpus and grow with it: they stay a distributed table. The workers hold the counts of
at most FREQUENT words; the counts of all other words reach the texts that have them by a join on the word.

Null text is the empty text: one end token. Rows are told apart by their place in the input, so null or repeated ids
are no matter. With no training text at all, every count is zero and the model is uniform over its classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stored, word_bytes

#: Most words whose counts the workers hold; a fixed bound, whatever the corpus.
FREQUENT = 300_000
OWN_CLASS, ENDING_CLASSES = 63, 63
CLASSES = 2 + OWN_CLASS + ENDING_CLASSES  # and the end token's, and one for all other endings
DIM, NEAR, HISTORY, NOISE = 16, 2, 32, 32
BATCH = 4096
END, OTHER = 0, 1


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the texts in column text; the end token is not among them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            found = pa.array(list(seen), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([found, pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in it:
            for text in batch.column(0).to_pylist():
                seen.update(word_bytes(text))
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Bounded view of the counts: classes, their totals, and the frequent words' counts."""

    index: dict[bytes, int]  # frequent word -> row of the arrays
    classes: np.ndarray
    counts: np.ndarray
    endings: dict[bytes, int]  # last two bytes -> class
    tokens: np.ndarray  # of each class in training
    distinct: np.ndarray
    total: int
    vocabulary: int

    def class_of(self, word: bytes) -> int:
        """Class of a word that has none of its own."""
        return self.endings.get(word[-2:], OTHER)


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The most frequent words with their counts, at most `most`: those whose count reaches the lowest eighth of an
    octave down to which there are not more. Only a histogram of such steps and the words themselves reach the driver."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = {r["b"]: r["v"] for r in counts.groupBy(step.alias("b")).agg(F.count("*").alias("v")).collect()}
    total, low = 0, None
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            break
        low = b
    if low is None:
        return []
    found = counts.where(step >= low).select("word", "n").toArrow()
    words = found.column("word").cast(pa.binary()).to_pylist()
    return sorted(zip(words, found.column("n").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def lexicon(counts: DataFrame, n_texts: int) -> Lexicon:
    """The bounded view. Words that have a class of their own are the most frequent; endings are the most frequent of
    the rest. Ties go by the word."""
    top = frequent_words(counts)
    own = {w: 2 + ENDING_CLASSES + i for i, (w, _) in enumerate(top[:OWN_CLASS])}
    ends: Counter = Counter()
    for w, n in top[OWN_CLASS:]:
        ends[w[-2:]] += n
    endings = {e: 2 + i for i, (e, _) in enumerate(sorted(ends.items(), key=lambda x: (-x[1], x[0]))[:ENDING_CLASSES])}
    classes = np.array([own.get(w) or endings.get(w[-2:], OTHER) for w, _ in top], np.int64)
    tokens, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    # Class totals over all words: by ending, then the own words are moved to their classes.
    raw = F.col("word").cast("binary")
    ending = F.hex(F.expr("substring(CAST(word AS BINARY), greatest(octet_length(word) - 1, 1), 2)"))
    known = {e.hex().upper(): k for e, k in endings.items()}
    by_end = counts.select(F.when(ending.isin(*known), ending).alias("e") if known else F.lit(None).cast("string").alias("e"), "n", raw.alias("raw"))
    for r in by_end.groupBy("e").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        k = known.get(r["e"], OTHER)
        tokens[k] += r["n"]
        distinct[k] += r["v"]
    for w, n in top[:OWN_CLASS]:
        k = endings.get(w[-2:], OTHER)
        tokens[k], distinct[k] = tokens[k] - n, distinct[k] - 1
        tokens[own[w]], distinct[own[w]] = n, 1
    if n_texts:
        tokens[END], distinct[END] = n_texts, 1
    return Lexicon(
        {w: i for i, (w, _) in enumerate(top)}, classes, np.array([n for _, n in top], np.int64), endings, tokens, distinct,
        int(tokens.sum()), int(distinct.sum()),
    )


class Parameters:
    """One flat vector, and views of it."""

    SHAPES = {"context": (CLASSES, DIM), "output": (CLASSES, DIM), "bias": (CLASSES,), "near": (NEAR, DIM), "far": (DIM, DIM)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def initial(cls, tokens: np.ndarray) -> Parameters:
        p = cls(np.random.default_rng(11).normal(0, 0.1, cls.size()).astype(np.float32))
        p.bias[:] = np.log((tokens + 1) / (tokens + 1).sum())
        p.near[:] = 0.5
        p.far[:] = np.eye(DIM)
        return p


def _contexts(ids: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Indices of the NEAR tokens before each token (0: the text's start, which counts as an end token), and the bounds
    of its history. first: index of the token's text's first token. Index 0 of the token list is a padding end token."""
    at = np.arange(len(ids))
    near = [np.where(at - d >= first, at - d, 0) for d in range(1, NEAR + 1)]
    return near, np.maximum(first, at - HISTORY), at


def _vectors(p: Parameters, ids: np.ndarray, first: np.ndarray):
    """Context vectors of all tokens, and what their gradient needs."""
    near, low, high = _contexts(ids, first)
    r = p.context[ids]
    total = np.zeros((len(ids) + 1, DIM), np.float32 if len(ids) < 10_000 else np.float64)
    np.cumsum(r, axis=0, out=total[1:])
    size = np.maximum(high - low, 1).astype(np.float32)[:, None]
    mean = ((total[high] - total[low]) / size).astype(np.float32)
    q = mean @ p.far
    for d, where in enumerate(near):
        q += p.near[d] * r[where]
    return q, r, near, low, high, size, mean


def _scattered(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows by class."""
    return np.stack([np.bincount(at, rows[:, d], CLASSES) for d in range(rows.shape[1])], axis=1)


def train_texts(p: Parameters, ids: np.ndarray, first: np.ndarray, noise_share: np.ndarray, rng: np.random.Generator, squares: np.ndarray, rate: float = 0.1) -> None:
    """One noise-contrastive step with adaptive rates. ids[0] is padding; noise samples are shared by the batch."""
    q, r, near, low, high, size, mean = _vectors(p, ids, first)
    target = ids[1:]
    noise = rng.choice(CLASSES, NOISE, p=noise_share)
    log_noise = np.log(NOISE * noise_share).astype(np.float32)
    qt = q[1:]
    own = p.output[target]
    right = 1 / (1 + np.exp(np.einsum("ij,ij->i", qt, own) + p.bias[target] - log_noise[target]))  # 1 - sigmoid
    wrong = 1 / (1 + np.exp(-(qt @ p.output[noise].T + p.bias[noise] - log_noise[noise])))
    grad = Parameters(np.zeros_like(p.flat))
    grad.output[:] = _scattered(target, right[:, None] * qt)
    np.subtract.at(grad.output, noise, wrong.T @ qt)
    grad.bias[:] = np.bincount(target, right, CLASSES)
    np.subtract.at(grad.bias, noise, wrong.sum(axis=0))
    gq = np.zeros_like(q)
    gq[1:] = right[:, None] * own - wrong @ p.output[noise]
    grad.far[:] = mean.T @ gq
    g_token = np.zeros_like(r)
    for d, where in enumerate(near):
        grad.near[d] = (gq * r[where]).sum(axis=0)
        part = gq * p.near[d]
        inside = (where > 0)[:, None]
        g_token[: -1 - d] += np.where(inside, part, 0)[1 + d :]
        g_token[0] += np.where(inside, 0, part).sum(axis=0)
    g_mean = (gq @ p.far.T) / size
    g_mean[high <= low] = 0
    spread = np.zeros((len(ids) + 1, DIM), np.float32)  # a history's gradient goes to all tokens from low to high
    starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    spread[low[starts]] = np.add.reduceat(g_mean, starts, axis=0)
    spread[high] -= g_mean
    g_token += np.cumsum(spread, axis=0)[:-1]
    grad.context[:] = _scattered(ids, g_token)
    g = grad.flat / len(target)
    squares += g * g
    p.flat += rate * g / (np.sqrt(squares) + 1e-8)


class Coder:
    """Texts as class numbers, frequent rows and rare words."""

    def __init__(self, lex: Lexicon):
        self.lex = lex

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        found = word_bytes(text)
        row = np.array(list(map(self.lex.index.get, found, [-1] * len(found))), np.int64)
        classes = np.empty(len(found) + 1, np.int64)
        classes[:-1] = self.lex.classes[row] if len(self.lex.classes) else OTHER
        rare = np.flatnonzero(row < 0)
        unseen = [found[i] for i in rare.tolist()]
        if unseen:
            classes[rare] = [self.lex.class_of(w) for w in unseen]
        classes[-1] = END
        return classes, row[row >= 0], unseen


def _blocks(coded: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Token lists with a padding token in front, of whole texts up to about size tokens (a longer text by itself), the
    first index of each token's text, and the number of texts."""
    pending, total = [], 0
    for ids in [*coded, None]:
        if pending and (ids is None or total + len(ids) > size):
            lengths = np.array([len(x) for x in pending])
            starts = 1 + np.cumsum(lengths) - lengths
            yield np.concatenate([[END], *pending]), np.concatenate([[0], np.repeat(starts, lengths)]), len(pending)
            pending, total = [], 0
        if ids is not None:
            pending.append(ids)
            total += len(ids)


def log_probabilities(p: Parameters, ids: np.ndarray, first: np.ndarray, block: int = 2048) -> np.ndarray:
    """Natural log-probability of the class of every token after the padding one."""
    q = _vectors(p, ids, first)[0][1:]
    target, out = ids[1:], np.empty(len(ids) - 1)
    for i in range(0, len(target), block):
        s = q[i : i + block] @ p.output.T
        s += p.bias
        if s.max() > 60 or s.min() < -60:  # else no exponential leaves the range
            s -= s.max(axis=1, keepdims=True)
        own = s[np.arange(len(s)), target[i : i + block]]
        np.exp(s, out=s)
        out[i : i + block] = own - np.log(s.sum(axis=1))
    return out


def train(docs: DataFrame, lex: Lexicon, rounds: int = 2) -> Parameters:
    """Parameters after one pass over the texts of docs, dealt to `rounds` rounds with averages in between."""
    p = Parameters.initial(lex.tokens)
    share = (lex.tokens + 1.0) / (lex.tokens + 1.0).sum()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(lex)
    size = Parameters.size()
    for k in range(rounds):
        begin = p.flat.copy()

        def run(it: Iterator[pa.RecordBatch], k: int = k, begin: np.ndarray = begin) -> Iterator[pa.RecordBatch]:
            coder, own = Coder(shared.value), Parameters(begin.copy())
            rng, squares, tokens, turn = np.random.default_rng(TaskContext.get().partitionId()), np.full(size, 1e-6, np.float32), 0, 0
            for batch in it:
                coded = []
                for text in batch.column(0).to_pylist():
                    if turn % rounds == k:
                        coded.append(coder(text)[0])
                    turn += 1
                for ids, first, _ in _blocks(coded, BATCH):
                    train_texts(own, ids, first, share, rng, squares)
                    tokens += len(ids) - 1
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(size, dtype=np.int32)), pa.array(own.flat.astype(np.float64) * tokens), pa.array(np.full(size, tokens, np.int64))], ["i", "x", "n"]
                )

        mean = docs.select("text").mapInArrow(run, "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).collect()
        if mean:
            flat = np.zeros(size, np.float32)
            for r in mean:
                flat[r["i"]] = r["x"]
            p = Parameters(flat)
    shared.unpersist()
    return p


def score(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, is_training, n_tokens, n_known, train_tokens, base_score, score) of every row: base_score is the unigram
    model with add-one smoothing, score the neural model, both base-10 logarithms of the whole text's probability."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), is_training.alias("is_training"))
    training = rows.where("is_training").select("text")
    counts = stored(count_words(training))
    lex = lexicon(counts, training.count())
    p = train(training, lex)
    shared = spark.sparkContext.broadcast((lex, p.flat))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, flat = shared.value
        coder, p = Coder(lex), Parameters(flat)
        log_count = np.log10(lex.counts + 1.0)
        inside = np.log10(lex.tokens + lex.distinct + 1.0)
        end_count = np.log10(lex.tokens[END] + 1.0)
        whole = np.log10(lex.total + lex.vocabulary + 1.0)
        task, seen = TaskContext.get().partitionId() << 36, 0
        for batch in it:
            coded, known, base, rare = [], [], [], []
            for text in batch.column("text").to_pylist():
                classes, frequent, unseen = coder(text)
                coded.append(classes)
                known.append(len(frequent) + bool(lex.tokens[END]))
                base.append(float(log_count[frequent].sum()) + end_count)
                rare.append(unseen)
            of_class = []
            for ids, first, n in _blocks(coded, 65536):
                lp = log_probabilities(p, ids, first) / np.log(10.0) - inside[ids[1:]]
                starts = np.flatnonzero(np.r_[True, first[2:] != first[1:-1]])
                of_class += np.add.reduceat(lp, starts).tolist()
            n = np.array([len(c) for c in coded], np.int64)
            base = np.array(base)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(task + seen + np.arange(batch.num_rows)), batch.column(0), batch.column(2), pa.array(n), pa.array(known, pa.int64()),
                    pa.array(base - n * whole), pa.array(base + np.array(of_class)), pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                ],
                ["row", "id", "is_training", "n_tokens", "known", "base", "model", "rare"],
            )
            seen += batch.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    partial = stored(
        rows.select("id", "text", "is_training").mapInArrow(run, f"row long, id {kind}, is_training boolean, n_tokens long, known long, base double, model double, rare array<string>")
    )
    rare = partial.select("row", F.explode("rare").alias("word"))
    found = rare.join(counts, "word").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("gain"))
    more, gain = F.coalesce("more", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    return partial.drop("rare").join(found, "row", "left").select(
        F.col("id").alias(id_col), "is_training", "n_tokens", (F.col("known") + more).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("model") + gain).alias("score"),
    )
