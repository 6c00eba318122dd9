"""Removal of repeated substrings: every byte that a substring of `length` bytes covers which also begins elsewhere.

The repeats are found by merging Burrows-Wheeler transforms (see bwt.py). To merge only what can repeat, each window of
`length` bytes is given the smallest hash of its k-grams, its anchor: equal windows have equal anchors. Neighbouring
windows with the same anchor form a run. Anchors are counted over all texts; runs whose anchor occurs once cannot
repeat. The segments (the bytes of the runs) of one anchor are brought together, equal ones once, and the windows that
repeat among them are those the merge puts into an interval with others. So the work that needs all of a group is
bounded by the distinct segments of an anchor; an anchor that very many places share is cut further, by the bytes that
eight neighbouring windows have in common, counted from the anchor's first gram in each window.

Texts that are equal as a whole count once in all this and are removed as a whole where they reach the length.

Defined cases: null text is the empty text; a text shorter than `length` loses nothing; ids do not matter, so they may be
null or repeated: rows with equal text are copies of each other whatever their ids. A cut may fall inside a character;
where text is wanted instead of bytes, the pieces of such characters go too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bwt
from quillstone.llm.common import stored
from quillstone.llm.sketch import Bloom

GRAM = 80
#: Occurrences of an anchor from which its runs are cut further; there are at most occurrences / HOT such anchors.
HOT, HOT_SHARE = 20_000, 1_000_000
PIECE = 8
#: Windows of a segment at most; longer runs (periodic texts) are cut.
MOST_WINDOWS = 512
#: Bytes of segments merged at once.
BATCH_BYTES = 90_000

_BYTE = np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k-gram, by doubling, then mixed."""
    factor = 0x9E3779B97F4A7C15
    power, span, cur = factor, 1, _BYTE[data]
    acc, acc_span = None, 0
    while k:
        if k & 1:
            if acc is None:
                acc, acc_span = cur, span
            else:
                n = len(data) - acc_span - span + 1
                acc = acc[:n] * np.uint64(power) + cur[acc_span : acc_span + n]
                acc_span += span
        k >>= 1
        if k:
            n = len(cur) - span
            cur = cur[:n] * np.uint64(power) + cur[span : span + n]
            power, span = power * power % (1 << 64), span * 2
    x = (acc ^ acc >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def runs(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, anchor, places of the anchors' grams in the runs' bytes, where each run's places begin and, last,
    end)."""
    width = length - gram + 1
    h = _gram_hashes(data, gram)
    m = _sliding_min(h, width)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    first, end = np.r_[0, cut], np.r_[cut, len(m)]
    anchor = m[first]
    span = end - first + width - 1
    begin = np.cumsum(span) - span
    at = np.arange(int(span.sum())) + np.repeat(first - begin, span)
    hit = np.flatnonzero(h[at] == np.repeat(anchor, span))
    owner = np.searchsorted(begin, hit, side="right") - 1
    return first, end, anchor.view(np.int64), at[hit], np.searchsorted(owner, np.arange(len(first) + 1))


def _mixed(key: tuple[int, int], at: np.ndarray) -> np.ndarray:
    x = (at.astype(np.uint64) + np.uint64(key[0] & (1 << 64) - 1)) * np.uint64(0x94D049BB133111EB)
    x = (x ^ x >> np.uint64(29)) + np.uint64(key[1] & (1 << 64) - 1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _encoded(batch: pa.RecordBatch, length: int) -> Iterator[tuple[tuple[int, int], bytes]]:
    for text, a, b in zip(batch.column("text").to_pylist(), batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True):
        if text and len(data := text.encode()) >= length:
            yield (a, b), data


def anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, n, least, most): places of each anchor over all texts; equal texts have equal places."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, data in _encoded(batch, length):
                first, _, anchor, _, begin = runs(np.frombuffer(data, np.uint8), length, gram)
                again = np.flatnonzero(np.diff(begin) > 1)
                a += [anchor, anchor[again]]
                p += [_mixed(key, first), _mixed(key, -first[again] - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(p))], ["anchor", "place"])

    out = texts.mapInArrow(run, "anchor long, place long")
    return out.groupBy("anchor").agg(F.count("*").alias("n"), F.min("place").alias("least"), F.max("place").alias("most"))


def segments(texts: DataFrame, length: int, gram: int, repeated: Bloom, hot: np.ndarray) -> DataFrame:
    """(bucket, s1, s2, k1, k2, start, more, data): the segments that may repeat. A task gives the bytes of equal segments
    once, and marks (shown) at most two of their places for the merge."""
    shared = texts.sparkSession.sparkContext.broadcast((repeated, hot))

    def cut(data: bytes, first: int, end: int, anchor: int, places: list[int], is_hot: bool) -> Iterator[tuple[int, int, int]]:
        """(bucket, first window, end) of a run's segments."""
        if not is_hot:
            for at in range(first, end, MOST_WINDOWS):
                yield anchor, at, min(at + MOST_WINDOWS, end)
            return
        at = first
        for place in places:  # pieces are counted from a window's first anchor, so that equal windows are in equal pieces
            while at < min(end, place + 1):
                piece = (place - at) // PIECE
                stop = min(end, place - piece * PIECE + 1)
                core = data[place - piece * PIECE : place - piece * PIECE - PIECE + 1 + length]
                yield xxhash.xxh64_intdigest(core, anchor & (1 << 63) - 1) - (1 << 63), at, stop
                at = stop

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = shared.value
        seen: dict[tuple[int, int], tuple | None] = {}
        for batch in it:
            rows: list[tuple] = []
            for key, data in _encoded(batch, length):
                first, end, anchor, place, begin = runs(np.frombuffer(data, np.uint8), length, gram)
                hit = np.flatnonzero(repeated.test(anchor))
                if not len(hit):
                    continue
                is_hot = np.isin(anchor[hit], hot)
                for i, h in zip(hit.tolist(), is_hot.tolist(), strict=True):
                    places = place[begin[i] : begin[i + 1]].tolist()
                    again = len(places) > 1
                    for bucket, a, b in cut(data, int(first[i]), int(end[i]), int(anchor[i]), places, h):
                        segment = data[a : b - 1 + length]
                        digest = xxhash.xxh3_128_digest(segment)
                        s = int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)
                        where = (*key, a)
                        state = seen.get(s, 0)
                        if state == 0:
                            seen[s] = where
                            rows.append((bucket, *s, *where, again, True, segment))
                        elif state is not None and state != where:
                            seen[s] = None
                            rows.append((bucket, *s, *where, again, True, None))
                        else:
                            rows.append((bucket, *s, *where, again, False, None))
            if len(seen) > 200_000:
                seen.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.binary()]
            names = ["bucket", "s1", "s2", "k1", "k2", "start", "more", "shown", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts.mapInArrow(run, "bucket long, s1 long, s2 long, k1 long, k2 long, start long, more boolean, shown boolean, data binary")


def _ranges(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows at these sorted places cover."""
    cut = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + length).tolist(), strict=True))


def repeated_ranges(shown: DataFrame, length: int) -> DataFrame:
    """(s1, s2, low, high): byte ranges, in the segments, of the windows that repeat. Rows of a bucket come together and
    are read in a stream; the distinct segments of complete buckets are merged in batches."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, data = [], []  # segments waiting for the merge
        waiting = 0
        out: list[tuple] = []

        def close(bucket: dict) -> None:
            nonlocal waiting
            for s, (places, _, segment) in bucket.items():
                if len(places) > 1 and segment is not None:
                    out.append((*s, 0, len(segment)))  # a whole segment that occurs twice
            if len(bucket) > 1 or any(more for _, more, _ in bucket.values()):
                for s, (_, _, segment) in bucket.items():
                    if segment is not None:
                        names.append(s)
                        data.append(segment)
                        waiting += len(segment)

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            if data:
                for s, places in zip(names, bwt.repeats(data, length), strict=True):
                    if len(places):
                        out.extend((*s, low, high) for low, high in _ranges(places, length))
            columns = list(zip(*out, strict=True)) or [()] * 4
            names.clear()
            data.clear()
            out.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["s1", "s2", "low", "high"])

        current, bucket = None, {}
        for batch in it:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "s1", "s2", "k1", "k2", "start", "more", "data")]
            for b, s1, s2, k1, k2, start, more, segment in zip(*columns, strict=True):
                if b != current:
                    close(bucket)
                    current, bucket = b, {}
                    if waiting >= BATCH_BYTES or len(out) > 50_000:
                        yield flush()
                places, again, known = bucket.get((s1, s2), (set(), False, None))
                if len(places) < 2:
                    places.add((k1, k2, start))
                bucket[s1, s2] = places, again or more, known if segment is None else segment
        close(bucket)
        yield flush()

    n = int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shown.select("bucket", "s1", "s2", "k1", "k2", "start", "more", "data")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "s1 long, s2 long, low long, high long")


def removed_ranges(docs: DataFrame, text_col: str = "text", length: int = 200, gram: int = GRAM) -> DataFrame:
    """(k1, k2, ranges): for each distinct text (named by two hashes) the byte ranges that go, as an array of (low, high),
    unordered and overlapping as they were found."""
    gram = min(gram, max(1, length // 2))
    text = F.coalesce(docs[text_col], F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    found = stored(anchors(texts, length, gram).where("n > 1 AND least <> most").select("anchor", "n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") > max(HOT, total // HOT_SHARE)).select("anchor").collect()
    places = stored(segments(texts, length, gram, Bloom.of(found.select("anchor"), 26), np.array([r["anchor"] for r in hot], np.int64)))
    covered = repeated_ranges(places.where("shown"), length)
    inner = places.select("s1", "s2", "k1", "k2", "start").join(covered, ["s1", "s2"])
    parts = inner.select("k1", "k2", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).distinct()
    copies = texts.select("k1", "k2", F.octet_length("text").cast("long").alias("size")).groupBy("k1", "k2", "size").agg(F.count("*").alias("n"))
    whole = copies.where((F.col("n") > 1) & (F.col("size") >= length)).select("k1", "k2", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    return parts.unionByName(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def _kept(data: bytes, ranges: list[dict] | None) -> tuple[bytes, int, int]:
    """Kept bytes, number removed and number of maximal removed runs."""
    if not ranges:
        return data, 0, 0
    parts, at, removed, spans = [], 0, 0, 0
    last = -1
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if low > last:
            spans += 1
        if high <= at:
            last = max(last, high)
            continue
        low = max(low, at)
        parts.append(data[at:low])
        removed += high - low
        at = last = high
    return b"".join([*parts, data[at:]]), removed, spans


def _with_ranges(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """docs' columns as c0, c1, ... and the ranges that go."""
    gone = removed_ranges(docs, text_col, length).toDF("__k1", "__k2", "__ranges")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    joined = rows.join(gone, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")), "left")
    return joined.select(*(rows[c].alias(f"c{i}") for i, c in enumerate(docs.columns)), F.col("__ranges").alias("ranges"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                kept, removed, spans = _kept(data, ranges)
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["c0", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_ranges(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text", length)
    kind = rows.schema["c0"].dataType.simpleString()
    return rows.mapInArrow(run, f"c0 {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("c0", id_col)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 200) -> DataFrame:
    """docs with the kept bytes as text (null stays null)."""
    at = docs.columns.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for text, ranges in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                texts.append(text if text is None or not ranges else _kept(text.encode(), ranges)[0].decode("utf-8", errors="ignore"))
            columns = [*batch.columns[:-1]]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = _with_ranges(docs, text_col, length)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return rows.mapInArrow(run, schema).toDF(*docs.columns)
