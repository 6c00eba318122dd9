"""Near-duplicate documents by SimHash fingerprints of their word shingles, verified on the shingle sets and made whole by
an exact set-similarity join.

A document is its set of word shingles; of fewer words than a shingle, one shingle of all. Documents without words have
one set of their own. Documents are linked if the Jaccard similarity of their sets is at least the threshold, and a
component is what chains of links connect. Candidates come from two sides: fingerprints that the one-wildcard variants of
simhash.py connect, and, as most copies near the threshold differ in more bits than those cover, the prefix, positional
and length filters of lines.py, which leave every pair that can reach the threshold. All candidates are verified on the
whole sets, so fingerprints neither link nor part documents by themselves.

Equal sets count once. Under a cluster of candidates the components are searched from a centre outwards, a set that is
reached is compared no more, and a star of edges is given, so a large group of near copies costs about one comparison a
set. The sets of a cluster meet in one task. Candidates are found by one 64-bit hash of a set; sets are told apart by two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import simhash
from quillstone.llm.common import materialize, stored
from quillstone.llm.components import connected
from quillstone.llm.lines import _STEP, PART_BYTES, _mix, _runs, _Sets, _Tokens, candidates, index_rows, token_counts
from quillstone.llm.sketch import Bloom

_BREAK = bytes(32 if b == 10 else b for b in range(256))
#: The one token of documents without words.
_NO_WORDS = np.uint64(0x5851F42D4C957F2D)


class Shingles(_Tokens):
    """Hashed word shingles of a batch of texts; each text is one line."""

    def __init__(self, shingle: int):
        super().__init__()
        self.shingle = shingle

    @staticmethod
    def parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Whole texts, together about PART_BYTES."""
        held, size = [], 0
        for i, t in enumerate(texts):
            data = (t or "").encode().translate(_BREAK)
            held.append((i, 0, data))
            size += len(data) + 1
            if size >= PART_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held

    def __call__(self, part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        word, line, text, number = super().__call__(part)
        n = np.bincount(line, minlength=len(text))
        end = np.cumsum(n)
        at = np.arange(len(word))
        at = at[(at + self.shingle <= end[line]) | (at == (end - n)[line])]
        last = end[line[at]]
        h = np.zeros(len(at), np.uint64)
        word = np.r_[word, np.zeros(self.shingle, np.uint64)]
        for i in range(self.shingle):
            h = h * np.uint64(_STEP) + np.where(at + i < last, word[at + i], np.uint64(0))
        none = np.flatnonzero(n == 0)
        return np.r_[_mix(h), np.full(len(none), _NO_WORDS)], np.r_[line[at], none], text, number


def fingerprinted(docs: DataFrame, shingle: int, counts) -> DataFrame:
    """(set, fp): name of the shingle set and SimHash of the shingles of each text of docs (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # a fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Shingles(shingle)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for part in tokens.parts(texts):
                s = _Sets(tokens, part, shared.value, 1)
                fp = np.array([simhash.fingerprint(texts[i], shingle) for i in s.text.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(s.set), pa.array(fp.view(np.int64))], ["set", "fp"])

    return docs.mapInArrow(run, "set long, fp long")


def alike(docs: DataFrame, shingle: int, counts, bits: int = 3) -> DataFrame:
    """(cluster, set): different sets of docs (id, text) whose fingerprints chains of at most `bits` differing bits connect."""
    named = stored(fingerprinted(docs, shingle, counts).distinct())
    clusters = named.join(simhash._roots(named, bits), "fp").select(F.xxhash64(F.lit("fp"), "root").alias("cluster"), "set").distinct()
    several = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return clusters.join(several.select("cluster"), "cluster", "left_semi")


def _sets_of(docs: DataFrame, shingle: int, counts, compared: Bloom) -> DataFrame:
    """(id, set, twin, tokens) of each row of docs (id, text); tokens only of sets that may have to be compared, and about
    once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast((compared, counts))  # fixed sizes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared, counts = shared.value
        tokens, given = Shingles(shingle), set()
        for batch in it:
            for part in tokens.parts(batch.column(1).to_pylist()):
                s = _Sets(tokens, part, counts, 1)
                twin, data = s.twin(), []
                for name, may, a, n in zip(zip(s.set.tolist(), twin.tolist(), strict=True), compared.test(s.set).tolist(), s.start.tolist(), s.size.tolist(), strict=True):
                    data.append(s.token[a : a + n].tobytes() if may and name not in given else None)
                    if may:
                        given.add(name)
                if len(given) > 500_000:
                    given.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.text)), pa.array(s.set), pa.array(twin), pa.array(data, pa.binary())], ["id", "set", "twin", "tokens"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, set long, twin long, tokens binary")


def _star(data: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """(member, centre), as places in data, of the sets that chains of links connect."""
    n = len(data)
    size = np.array([len(d) >> 3 for d in data])
    values, flat = np.unique(np.frombuffer(b"".join(data), np.uint64), return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(values), np.int64)
    free = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for centre in range(n):
        if not free[centre]:
            continue
        free[centre] = False
        queue = [centre]
        while queue:
            i = queue.pop()
            fits = np.flatnonzero(free & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i]) - 1e-9))
            if not len(fits):
                continue
            own = flat[start[i] : start[i] + size[i]]
            mark[own] = 1
            begin = np.cumsum(size[fits]) - size[fits]
            at = np.arange(int(size[fits].sum())) + np.repeat(start[fits] - begin, size[fits])
            both = np.add.reduceat(mark[flat[at]], begin)
            mark[own] = 0
            hit = fits[both * (1 + threshold) >= threshold * (size[fits] + size[i]) - 1e-9]
            free[hit] = False
            queue += hit.tolist()
            out += [(j, centre) for j in hit.tolist()]
    return out


NAME = "struct<set: bigint, twin: bigint>"


def stars(pool: DataFrame, threshold: float) -> DataFrame:
    """(a, b): edges between the sets of pool (cluster, set, twin, tokens), named by set and twin, that connect exactly those
    that chains of links within a cluster connect."""

    def handle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, name, twin = (t.column(c).to_numpy() for c in ("cluster", "set", "twin"))
        tokens = t.column("tokens")
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        a, b = [], []
        for at, n in zip(first.tolist(), np.diff(np.r_[first, len(key)]).tolist(), strict=True):
            for member, centre in _star(tokens.slice(at, n).to_pylist(), threshold):
                a.append(at + member)
                b.append(at + centre)
        named = lambda at: pa.StructArray.from_arrays([pa.array(name[at], pa.int64()), pa.array(twin[at], pa.int64())], ["set", "twin"])
        yield pa.RecordBatch.from_arrays([named(np.array(x, np.int64)) for x in (a, b)], ["a", "b"])

    n = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pool.select("cluster", "set", "twin", "tokens").repartition(n, "cluster").sortWithinPartitions("cluster")
    return rows.mapInArrow(lambda it: _runs(it, handle), f"a {NAME}, b {NAME}")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs' rows, one of each component: that of the smallest id (null last), of equal ids that of the smallest text
    hash, of rows equal in id and text any one."""
    text_hash = F.xxhash64(docs[text_col])
    rows = docs.select(F.struct(docs[id_col].isNull().alias("no"), docs[id_col].alias("id"), text_hash.alias("hash")).alias("id"), docs[text_col].alias("text"))
    tokens = Shingles(shingle)
    counts, twice = token_counts(rows, tokens)
    found = candidates(index_rows(rows, threshold, 1, counts, twice, tokens), threshold).where("cluster IS NOT NULL").distinct()
    found = materialize(alike(rows, shingle, counts).unionByName(found))
    of_doc = stored(_sets_of(rows, shingle, counts, Bloom.of(found.select("set"))))
    pool = found.join(of_doc.where("tokens IS NOT NULL").select("set", "twin", "tokens").dropDuplicates(["set", "twin"]), "set")
    linked = stored(connected(stars(pool, threshold))).toDF("name", "linked")
    least = of_doc.groupBy(F.struct("set", "twin").alias("name")).agg(F.min("id").alias("least")).join(linked, "name", "left")
    least = least.groupBy(F.coalesce("linked", "name").alias("root")).agg(F.min("least").alias("least"))
    chosen = least.select(F.col("least.id").alias("__id"), F.col("least.hash").alias("__hash"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("__text_hash", F.xxhash64(names[docs.columns.index(text_col)]))
    own = names[docs.columns.index(id_col)]
    kept = rows.join(chosen, rows[own].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    return kept.dropDuplicates([own, "__text_hash"]).drop("__text_hash").toDF(*docs.columns)
