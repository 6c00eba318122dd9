"""Quality classifier: naive Bayes support vectors over hashed byte n-gram indicators.

Each indicator is scaled by its class log-count ratio, each document's vector to unit length, and a linear hinge-loss
model is fitted by dual coordinate descent. A logistic curve, fitted on the training margins, turns margins into scores.

The model is fitted on the driver from a bounded sample of labelled rows: about `max_rows` of them and `max_bytes` of their
indicator numbers, those of the lowest 64-bit hashes. Ids are sampled first; where ids repeat or texts are long, rows are
sampled again. Rows of equal id, label and text teach once. Scoring covers every whole text.

Defined cases: null and empty texts have no indicator and get the bias's score; labels that are null are no labels; a
document with several labels teaches each of them; with labels of one class or none the score is that class's share
(0.5 for none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import below_share, stored

BITS = 18
#: Bounds on the labelled rows that the fit uses, and on the bytes of their indicators (four for each).
MAX_ROWS, MAX_BYTES = 12_000, 256 << 20


class Indicators:
    """Distinct hashed byte 2-grams and 3-grams of a text, in linear time and without sorting."""

    def __init__(self):
        self.seen = np.zeros(1 << BITS, np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
        if len(b) < 2:
            return np.zeros(0, np.int64)
        two = b[:-1] | b[1:] << np.uint32(8)
        three = two[:-1] | b[2:] << np.uint32(16)
        grams = np.concatenate([two | np.uint32(0xFF000000), three])
        slot = ((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
        place = np.arange(len(slot))
        self.seen[slot] = place  # of equal slots one place stays
        return slot[self.seen[slot] == place]


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        if not len(slots):
            return self.bias
        r = self.ratio[slots]
        norm = float(np.sqrt((r * r).sum()))
        return float(self.weight[slots].sum()) / norm + self.bias if norm else self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << BITS), alpha)
    for slots, label in zip(rows, y, strict=True):
        counts[label, slots] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i max(0, 1 - y_i (w x_i + b)), the bias being a constant feature.
    Coordinates whose projected gradient shows that they stay at a bound are skipped within an epoch."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost[i] else gradient
            worst = max(worst, abs(projected))
            if abs(projected) < 1e-12:
                continue
            old = alpha[i]
            alpha[i] = min(max(old - gradient / square[i], 0.0), cost[i])
            move = (alpha[i] - old) * y[i]
            w[rows[i]] += move * values[i]
            b += move
        if worst < tolerance:
            break
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, with smoothed targets, by Newton steps."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margin * margin).sum(), (v * margin).sum()], [(v * margin).sum(), v.sum()]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0) -> Model:
    labels = np.asarray(labels, np.int64)
    size = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        edge = 1e-9
        share = min(max(share, edge), 1 - edge)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratio = log_count_ratio(rows, labels)
    values = [((r := ratio[s]) / (np.sqrt((r * r).sum()) or 1.0)).astype(np.float32) for s in rows]
    sign = np.where(labels == 1, 1.0, -1.0)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * cost  # both classes weigh the same
    w, b = dual_coordinate_descent(rows, values, sign, balance, size)
    model = Model(ratio, w * ratio, b, 1.0, 0.0)
    model.slope, model.shift = _platt(np.array([model.margin(s) for s in rows]), labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on about max_rows of the labelled documents at most, and about max_bytes of their indicators, as said above."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots_of = Indicators()
        for batch in it:
            packed = [slots_of(t).astype(np.uint32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], ["key", "y", "slots"])

    known = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull()).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).distinct()
    total = known.count()
    if total > max_rows:
        known = known.where(below_share(F.xxhash64("id"), max_rows / total))
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = texts.join(F.broadcast(known), "id").select(F.xxhash64("id", "y", F.coalesce("text", F.lit(""))).alias("key"), "y", "text")
    found = stored(rows.mapInArrow(run, "key long, y int, slots binary"))
    n, size = found.agg(F.approx_count_distinct("key", 0.02), F.sum(F.length("slots"))).first()
    share = min(1.0, max_rows / max(1, n), max_bytes / max(1, size or 0))
    sampled = found if share > 0.9 else found.where(below_share(F.xxhash64("key"), share))  # the key's own low end was taken with the ids'
    sampled = sampled.dropDuplicates(["key"]).select("y", "slots")
    # Arrow batches rather than rows, and slots of four bytes that are views of them: the driver holds each once.
    table = sampled.toArrow()
    found.unpersist()
    y, packed = table.column("y").to_pylist(), table.column("slots").to_pylist()
    del table
    order = sorted(range(len(y)), key=lambda i: (y[i], packed[i]))  # whatever order the tasks ended in
    return fit_rows([np.frombuffer(packed[i], np.uint32) for i in order], np.array([y[i] for i in order], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", as_filter: float | None = None) -> DataFrame:
    """All columns of docs (an own column score gives way) and score double; with as_filter, docs' own columns of the rows that score at least that."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed 2^18 numbers, twice
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots_of = shared.value, Indicators()
        for batch in it:
            s = m.score(np.array([m.margin(slots_of(t)) for t in batch.column(at).to_pylist()]).reshape(-1))
            if as_filter is not None:
                yield batch.filter(pa.array(s >= as_filter))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    if as_filter is not None:
        return docs.mapInArrow(run, docs.schema)
    names = [f"c{i}" for i in range(len(docs.columns))]  # an input column may itself be called score
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = docs.toDF(*names).mapInArrow(run, f"{schema}, score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c != "score"), "score")
