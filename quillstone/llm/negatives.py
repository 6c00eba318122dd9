"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A further component makes all vectors equally long: sqrt(M^2 - |x|^2), M being the greatest norm; for an anchor it is 0.
Then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a greater score is a smaller distance, and a window of scores is an annulus around
the anchor. The tree's vantage points come from a bounded sample of rows; every row is led to a leaf, and the leaves keep
the least and the greatest distance of their rows to each vantage point on their path. By the triangle inequality these
bound the distances, and so the scores, between an anchor and all rows of a leaf.

A search visits the leaves that an annulus can reach nearest-first, in rounds of one, eight, sixty-four ... leaves, and
ends as soon as the k-th score found is above every leaf that is left; ties are visited. It is exact: the sample only
decides how well the tree separates. Positives are searched in the annulus of all scores among rows of the anchor's
label, negatives in each positive's annulus among rows of other labels.

Leaves larger than a block are dealt in blocks by a hash of the id; a task holds one block at a time and meets the
anchors in batches. Of rows equal in vector and label only as many as an answer can hold are indexed, those of the
smallest ids, so a vector that a third of the rows share does not fill a leaf.

Defined cases: rows with a null id, label or vector, or with a component that is null, not a number or infinite, take no
part. Equal rows count once; of rows that share an id the smallest by label and vector counts. Shorter vectors are filled
up with zeros. Ties go to the smaller id. Scores beyond a long raise an error. Negative positive-scores have an empty
window if the lower percentage is below the upper one. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize

#: Rows that the tree is built from, those of the smallest hashes; rows aimed at in a leaf; the deepest tree.
SAMPLE, LEAF_ROWS, DEPTH = 16_384, 1024, 10
#: Rows in a block of a large leaf.
BLOCK_ROWS = 4096
GROWTH = 8


def points(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v array<long>): the rows that take part, each component x as floor(scale * x)."""
    x = vectors[vec_col]
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(vectors[id_col].isNotNull() & vectors[label_col].isNotNull() & x.isNotNull()).where(finite)
    v = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return rows.select(rows[id_col].alias("id"), rows[label_col].alias("label"), v.alias("v"))


def _few(rows: DataFrame, k: int, parts: int = 16) -> DataFrame:
    """rows, of those equal in vector and label the k of the smallest ids: first within hash parts."""
    within = Window.partitionBy("v", "label", "part").orderBy("id")
    of_all = Window.partitionBy("v", "label").orderBy("id")
    some = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("r", F.row_number().over(within)).where(F.col("r") <= k)
    return some.withColumn("r", F.row_number().over(of_all)).where(F.col("r") <= k).select("id", "label", "v")


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floats where these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("a score may not fit a long")
    return a @ b.T


@dataclass
class Tree:
    """A complete binary tree: node i has the inner child 2i+1, within its radius, and the outer child 2i+2."""

    greatest: float  # M^2
    depth: int
    vantage: np.ndarray  # (nodes, dim + 1)
    radius: np.ndarray
    least: np.ndarray | None = None  # (leaves, depth): of the distances to the vantage points on the path
    most: np.ndarray | None = None
    blocks: np.ndarray | None = None  # of each leaf; 0 for an empty one

    def augmented(self, v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(0.0, self.greatest - (x * x).sum(axis=1)))]

    def route(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row, and its distances to the vantage points on the way."""
        x, node = self.augmented(v), np.zeros(len(v), np.int64)
        way = np.zeros((len(v), self.depth))
        for level in range(self.depth):
            d = np.sqrt(((x - self.vantage[node]) ** 2).sum(axis=1))
            way[:, level] = d
            node = 2 * node + 1 + (d > self.radius[node])
        return node - ((1 << self.depth) - 1), way

    def paths(self) -> np.ndarray:
        """(leaves, depth): the nodes on each leaf's path."""
        at = np.arange(1 << self.depth) + (1 << self.depth) - 1
        out = np.zeros((len(at), self.depth), np.int64)
        for level in reversed(range(self.depth)):
            at = (at - 1) >> 1
            out[:, level] = at
        return out

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, leaves) bounds of the scores, widened by what rounding may do."""
        x = q.astype(np.float64)
        square = (x * x).sum(axis=1)
        near, far = np.zeros((len(q), 1 << self.depth)), np.full((len(q), 1 << self.depth), np.inf)
        if self.depth:
            apart = square[:, None] + self.greatest - 2 * (x @ self.vantage[:, :-1].T)
            d = np.sqrt(np.maximum(0.0, apart))
            paths = self.paths()
            for level in range(self.depth):
                to = d[:, paths[:, level]]
                near = np.maximum(near, np.maximum(to - self.most[:, level], self.least[:, level] - to))
                far = np.minimum(far, to + self.most[:, level])
        whole = square[:, None] + self.greatest
        slack = 1 + 1e-9 * whole
        return (whole - far * far) / 2 - slack, (whole - near * near) / 2 + slack


def build(sample: np.ndarray, greatest: float, depth: int, dim: int, seed: int = 11) -> Tree:
    """Vantage points are, of a few candidates, those whose distances to the node's rows spread most; the radius is the
    median distance."""
    nodes, rng = (1 << depth) - 1, np.random.default_rng(seed)
    tree = Tree(greatest, depth, np.zeros((nodes, dim + 1)), np.zeros(nodes))
    x = tree.augmented(sample)
    members = {0: np.arange(len(x))}
    for node in range(nodes):
        own = members.pop(node, np.zeros(0, np.int64))
        if len(own):
            tried = rng.choice(own, min(8, len(own)), replace=False)
            some = x[rng.choice(own, min(256, len(own)), replace=False)]
            spread = [np.sqrt(((some - x[t]) ** 2).sum(axis=1)).std() for t in tried]
            tree.vantage[node] = x[tried[int(np.argmax(spread))]]
            d = np.sqrt(((x[own] - tree.vantage[node]) ** 2).sum(axis=1))
            tree.radius[node] = np.median(d)
            inner = d <= tree.radius[node]
            members[2 * node + 1], members[2 * node + 2] = own[inner], own[~inner]
    return tree


@dataclass
class Index:
    rows: DataFrame  # (unit, id, label, v)
    tree: Tree
    dim: int


def indexed(rows: DataFrame, sample_rows: int = SAMPLE, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> Index | None:
    """The tree over rows (id, label, v), and rows by unit, which is a leaf's block. None if there are no rows."""
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("greatest")).first()
    if not facts["n"]:
        return None
    dim = max(1, facts["dim"])
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(facts["n"] / leaf_rows)))))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    tree = build(matrix(sample, dim), facts["greatest"], depth, dim)
    shared = spark.sparkContext.broadcast(tree)  # at most 2^DEPTH vantage points

    def lead(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in it:
            leaf, way = tree.route(matrix(batch.column(2), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), *(pa.array(way[:, i]) for i in range(depth))], ["id", "label", "v", "leaf", *(f"d{i}" for i in range(depth))])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    led = materialize(rows.select("id", "label", "v").mapInArrow(lead, f"id {kinds['id']}, label {kinds['label']}, v array<bigint>, leaf bigint" + "".join(f", d{i} double" for i in range(depth))))
    least, most = [[f(f"d{i}").alias(f"{n}{i}") for i in range(depth)] for f, n in ((F.min, "least"), (F.max, "most"))]
    tree.least, tree.most = np.full((1 << depth, depth), np.inf), np.zeros((1 << depth, depth))
    tree.blocks = np.zeros(1 << depth, np.int64)
    for r in led.groupBy("leaf").agg(F.count("*").alias("n"), *least, *most).collect():  # at most 2^DEPTH rows
        tree.blocks[r["leaf"]] = -(-r["n"] // block_rows)
        tree.least[r["leaf"]], tree.most[r["leaf"]] = [r[f"least{i}"] for i in range(depth)], [r[f"most{i}"] for i in range(depth)]
    block = F.pmod(F.xxhash64("id"), F.element_at(F.array(*(F.lit(max(1, int(b))) for b in tree.blocks)), F.col("leaf").cast("int") + 1))
    return Index(led.select((F.col("leaf") * (1 << 32) + block).alias("unit"), "id", "label", "v"), tree, dim)


def _visits(probes: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """Each probe with the units of the leaves from place begin to end in its order, as far as they can still matter."""
    shared, dim = probes.sparkSession.sparkContext.broadcast(index.tree), index.dim

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in it:
            low, high, kth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("low", "high", "kth"))
            worst, best = tree.bounds(matrix(batch.column("v"), dim))
            reached = (best >= low[:, None]) & (worst <= high[:, None]) & (tree.blocks > 0)
            order = np.argsort(np.where(reached, -np.minimum(best, high[:, None]), np.inf), axis=1, kind="stable")[:, begin:end]
            take = np.take_along_axis(reached & ~(best < kth[:, None]), order, axis=1)
            row, place = np.nonzero(take)
            leaf = order[row, place]
            many = tree.blocks[leaf]
            unit = np.repeat(leaf << 32, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out = batch.take(pa.array(np.repeat(row, many)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(unit, pa.int64())], [*out.schema.names, "unit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in probes.schema)
    return probes.mapInArrow(run, f"{schema}, unit bigint")


def _met(visits: DataFrame, index: Index, k: int) -> DataFrame:
    """(anchor, pair, id, score): of each visited unit the first k rows that a probe may take. Rows of a unit come before
    the probes that visit it; a task holds one unit."""
    dim, n = index.dim, int(visits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probe = F.struct("anchor", "pair", "low", "high", "kth", "same")
    both = index.rows.select("unit", F.lit(False).alias("visits"), "id", "label", "v", F.lit(None).cast(visits.select(probe.alias("p")).schema["p"].dataType).alias("probe"))
    both = both.unionByName(visits.select("unit", F.lit(True).alias("visits"), F.col("anchor").alias("id"), "label", "v", probe.alias("probe")))

    def answers(block: list[pa.RecordBatch], probes: pa.RecordBatch) -> pa.RecordBatch:
        ids = np.concatenate([b.column("id").to_numpy(zero_copy_only=False) for b in block])
        labels = np.concatenate([b.column("label").to_numpy(zero_copy_only=False) for b in block])
        scores = products(matrix(probes.column("v"), dim), np.concatenate([matrix(b.column("v"), dim) for b in block]))
        low, high, kth, same, pair = (probes.column("probe").field(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "kth", "same", "pair"))
        anchor, label = (probes.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        fits = (scores >= np.maximum(low, kth)[:, None]) & (scores <= high[:, None]) & (ids != anchor[:, None]) & ((labels == label[:, None]) == same[:, None])
        rows, found = [], []
        for i in np.flatnonzero(fits.any(axis=1)).tolist():
            at = np.flatnonzero(fits[i])
            if len(at) > k:
                own = scores[i, at]
                at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
            at = at[np.lexsort((ids[at], -scores[i, at]))[:k]]
            rows += [i] * len(at)
            found += at.tolist()
        return pa.RecordBatch.from_arrays([pa.array(anchor[rows]), pa.array(pair[rows]), pa.array(ids[found]), pa.array(scores[rows, found])], ["anchor", "pair", "id", "score"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, []
        for batch in it:
            unit, visits = batch.column("unit").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (visits[1:] != visits[:-1])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(unit)], strict=True):
                if unit[a] != held:
                    held, block = unit[a], []
                if not visits[a]:
                    block.append(batch.slice(a, b - a))
                else:
                    for at in range(a, b, 256):
                        yield answers(block, batch.slice(at, min(256, b - at)))

    kind = index.rows.schema["id"].dataType.simpleString()
    sorted_rows = both.repartition(n, "unit").sortWithinPartitions("unit", "visits")
    return sorted_rows.mapInArrow(run, f"anchor {kind}, pair {kind}, id {kind}, score bigint")


def nearest(probes: DataFrame, index: Index, k: int) -> DataFrame:
    """(anchor, pair, id, score, rank): for each probe (anchor, pair, label, v, low, high, same) the first k rows of the same
    or of other labels whose scores lie between low and high."""
    by_probe = Window.partitionBy("anchor", "pair").orderBy(F.desc("score"), "id")
    nothing = F.lit(-(1 << 63)).cast("long")
    best, begin, width, leaves = None, 0, 1, 1 << index.tree.depth
    while begin < leaves:
        if best is None:
            current = probes.withColumn("kth", nothing)
        else:
            kth = best.where(F.col("rank") == k).select("anchor", "pair", F.col("score").alias("kth"))
            current = probes.join(kth, ["anchor", "pair"], "left").withColumn("kth", F.coalesce("kth", nothing))
        visits = materialize(_visits(current, index, begin, begin + width))
        if best is not None and visits.isEmpty():
            break
        found = _met(visits, index, k)
        pool = found if best is None else best.drop("rank").unionByName(found)
        best = materialize(pool.withColumn("rank", F.row_number().over(by_probe)).where(F.col("rank") <= k))
        begin, width = begin + width, width * GROWTH
    return best


def _window(score: str, low: int, high: int) -> list[Column]:
    """The least and the greatest whole score s with low * score <= 100 * s <= high * score."""
    least = F.expr(f"CASE WHEN {score} >= 0 THEN ({low} * {score} + 99) div 100 ELSE ({low} * {score}) div 100 END")
    most = F.expr(f"CASE WHEN {score} >= 0 THEN ({high} * {score}) div 100 ELSE ({high} * {score} - 99) div 100 END")
    return [least.alias("low"), most.alias("high")]


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, **sizes: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v), of which anchors
    are those for which the given column of these holds. low and high are percentages of the positive's score, not
    negative."""
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v"))
    kind = rows.schema["id"].dataType.simpleString()
    index = indexed(materialize(_few(rows, max(positives + 1, negatives))), **sizes)
    if index is None:
        return rows.sparkSession.createDataFrame([], f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score bigint, negative_score bigint")
    v = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(index.dim) - F.size("v")))
    asked = rows.where(anchors).select(F.col("id").alias("anchor"), "label", v.alias("v"))
    ends = [F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high")]
    own = nearest(asked.select("anchor", F.col("anchor").alias("pair"), "label", "v", *ends, F.lit(True).alias("same")), index, positives)
    pairs = own.select("anchor", F.col("id").alias("pair"), F.col("score").alias("positive_score"))
    windows = pairs.withColumns(dict(zip(("low", "high"), _window("positive_score", low, high), strict=True))).where("low <= high")
    others = nearest(windows.drop("positive_score").join(asked, "anchor").select("anchor", "pair", "label", "v", "low", "high", F.lit(False).alias("same")), index, negatives)
    out = others.join(pairs, ["anchor", "pair"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("pair").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
