"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most three bits have a
segment that differs in at most one, so they agree on that segment with one bit, the wildcard, taken out. Each distinct
fingerprint is indexed under its 2 x 32 one-wildcard variants; equal variants meet by a shuffle on the variant and are
verified on all 64 bits. A segment that very many distinct fingerprints share is cut once more: its variants are
combined with the 2 x 16 one-wildcard variants of the other segment's halves. At most 2^18 fingerprints can agree on
such a combined variant, whatever the input, so no task meets an unbounded group and no link is lost.

Exact copies meet in one fingerprint before any of this. Each variant returns a spanning star of its links, not its
pairs. Null text is the empty text: no words, fingerprint zero, linked like any other. A null id never becomes a
component's id unless all of its ids are null. Rows that repeat get the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stored, words
from quillstone.llm.components import connected

#: Distinct fingerprints with the same segment from which its variants are cut again.
HOT_SEGMENT = 2048
#: Hot segments up to which their variants are broadcast (32 rows of 8 bytes each); beyond, they are joined by shuffle.
BROADCAST_SEGMENTS = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles, repeats included, as an unsigned integer. A bit is set if over half the XXH64
    (seed 42) hashes have it. Fewer words than a shingle: one shingle of all; no words: zero."""
    found = words(text)
    if not found:
        return 0
    data = " ".join(found).encode()
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(data, 42)
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = [0, *(blanks[: len(blanks) - shingle + 1] + 1).tolist()]
    ends = [*blanks[shingle - 1 :].tolist(), len(data)]
    hashes = np.array([digest(data[s:e], 42) for s, e in zip(starts, ends, strict=True)], ">u8")
    votes = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of each row's whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _labels_by_blocks(fps: np.ndarray, bits: int) -> np.ndarray:
    """Smallest index each fingerprint reaches, by comparing blocks with all."""
    n = len(fps)
    label = np.arange(n)
    while True:
        new = label.copy()
        for at in range(0, n, 256):
            near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, :]) <= bits
            new[at : at + 256] = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _labels_by_masks(fps: np.ndarray, bits: int) -> np.ndarray:
    """The same for a large group in which few bits vary: every neighbour is looked up."""
    n = len(fps)
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    places = [1 << i for i in range(64) if varying >> i & 1]
    masks = [sum(c) for k in range(1, bits + 1) for c in combinations(places, k)]
    order = np.argsort(fps)
    ranked = fps[order]
    label = np.arange(n)
    while True:
        new = label.copy()
        for mask in masks:
            other = ranked ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            hit = ranked[at] == other
            new[hit] = np.minimum(new[hit], label[at[hit]])
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _stars(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Star edges (member, centre) of the linked fingerprints of every run of equal keys."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    pair = first[size == 2]
    near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= bits]
    a, b = [fps[near]], [fps[near + 1]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        group = fps[at : at + n]
        label = _labels_by_blocks(group, bits) if n <= 2 * HOT_SEGMENT else _labels_by_masks(group, bits)
        member = np.flatnonzero(label != np.arange(n))
        a.append(group[member])
        b.append(group[label[member]])
    return a, b


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints fp that connect exactly those that a chain of links of at most `bits`
    (at most three) differing bits connects."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one wildcard cover at most three differing bits")
    low = F.lit(0xFFFFFFFF)
    both = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.shiftrightunsigned("fp", 32).alias("seg")), F.struct(F.lit(1).alias("s"), F.col("fp").bitwiseAND(low).alias("seg"))))
    hot = stored(fps.select(both.alias("x")).select("x.s", "x.seg").groupBy("s", "seg").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENT).drop("n"))
    wild = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")
    key = "(((s * 32L + i) << 32) | (seg & ~(1L << i)))"
    variants = fps.select("fp", both.alias("x")).select("fp", "x.s", "x.seg", wild).select("fp", "s", F.expr(key).alias("key"))
    hot_count = hot.count()
    if hot_count:
        hot_keys = hot.select("s", "seg", wild).select(F.expr(key).alias("key")).distinct().withColumn("hot", F.lit(True))
        if hot_count <= BROADCAST_SEGMENTS:
            hot_keys = F.broadcast(hot_keys)
        variants = variants.join(hot_keys, "key", "left")
        other = "(CASE WHEN s = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
        half = f"(CASE WHEN j < 16 THEN {other} >> 16 ELSE {other} & 65535L END)"
        again = F.expr("CASE WHEN hot THEN sequence(0, 31) ELSE array(-1) END")
        variants = variants.select("fp", "s", "key", F.explode(again).alias("j")).select(
            "fp", F.expr(f"CASE WHEN j < 0 THEN -(key << 21) - 1 ELSE (key << 21) | (CAST(j AS BIGINT) << 16) | ({half} & ~(1L << (j % 16))) END").alias("key")
        )
    else:
        variants = variants.select("fp", "key")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vals = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in it:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            vals = np.concatenate([vals, batch.column(1).to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if whole:
                yield _edges(*_stars(keys[:whole], vals[:whole], bits))
                keys, vals = keys[whole:], vals[whole:]
        if len(keys):
            yield _edges(*_stars(keys, vals, bits))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return variants.select("key", "fp").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    edges = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _roots(of_doc: DataFrame, bits: int) -> DataFrame:
    """(fp, root): the smallest fingerprint, as a signed number, that a chain of links reaches."""
    distinct = stored(of_doc.select("fp").distinct())
    roots = stored(connected(links(distinct, bits))).toDF("fp", "linked")
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("linked", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """(id, fingerprint, component_id): 16 hex digits, and the smallest id that a chain of links reaches."""
    of_doc = stored(fingerprints(docs, id_col, text_col, shingle))
    root = stored(_roots(of_doc, bits))
    least = of_doc.groupBy("fp").agg(F.min("id").alias("least")).join(root, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    component = root.join(least, "root").select("fp", "component_id")
    return of_doc.join(component, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
