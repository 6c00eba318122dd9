"""Near-duplicate lines by an exact set-similarity join.

A line is its set of distinct words. A line goes if an earlier line of the corpus, in the order of document id and then
line number, has a Jaccard similarity of at least the threshold; lines of fewer than `min_words` distinct words, blank
ones among them, stay. What counts is the input: a line that goes itself still removes later ones.

Tokens are ordered by rarity (counts over all lines, kept in a sketch of fixed size; any common order gives the same
result). Two lines can only be similar if they share a token in their prefixes, so only prefix tokens are indexed, and of
these only those that may occur twice. Under each token lines meet sorted by size; the length filter, the positional
filter, the shorter indexing prefix of the smaller set and a parity-bit filter (each token that only one line has flips
one bit) leave few candidates, and signatures of 512 parity bits fewer. A token that is very common is indexed together with the next token of the prefix, as two
similar lines of two or more words share at least two. Sets that meet are put into clusters, named by
their smallest set, so that near copies of one line are mostly in one cluster and their tokens travel once; clusters beyond
CLUSTER_ROWS are compared in pairs of blocks. There Jaccard is verified on the whole sets, with
the earliest set of every cluster compared first, and a set that has met an earlier similar one is not compared again. All
pairs are never written. Equal sets within a task count once before anything is shuffled.

Defined cases: null text stays null; ids may be null (first in the order) or repeated (lines of the same id and number
are not earlier than each other); whole-number ids are ordered by value, others by hash. Sets are named by 128 bits; the
index carries 64 of them, which only decides who is compared. Columns of the input named n_lines or n_removed give way to
the ones of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import materialize
from quillstone.llm.sketch import SLICES, Bloom, merged

COUNT_BITS, TWICE_BITS = 18, 25
#: Bytes of text that numpy works on at once.
PART_BYTES = 1 << 20
#: Bytes of sorted rows that are handled at once, beyond a run.
RUN_BYTES = 1 << 24
#: Uses of a token from which it is indexed in pairs.
COMMON = 20_000
#: Sorted rows that are handled at once, beyond a run.
ROWS_AT_ONCE = 200_000
#: Sets of a cluster that one task compares with each other; larger clusters are dealt out in pairs of blocks.
CLUSTER_ROWS = 20_000
#: Candidate pairs of sets, and tokens, that numpy works on at once.
PAIRS_AT_ONCE = 1 << 21
TOKENS_AT_ONCE = 1 << 21
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 11, 12, 13) else b for b in range(256))
# Word hashes are differences of prefix sums of byte values times powers of an odd number, modulo 2^64.
_STEP = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(h: np.ndarray, by: int = 0x94D049BB133111EB) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(by)
    return h ^ h >> np.uint64(30)


class _Tokens:
    """Hashed words of a batch of texts, with the text and line each belongs to, without a Python step for each word."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, PART_BYTES + (1 << 16))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size, base, np.uint64)], dtype=np.uint64) for base in (np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))))

    @staticmethod
    def parts(texts: list[str | None]) -> Iterator[list[tuple[int, int, bytes]]]:
        """(text, number of its first line, bytes) of whole lines, together about PART_BYTES: long texts are cut at line
        breaks, as the arrays take many times the bytes."""
        held, size = [], 0
        for i, t in enumerate(texts):
            if not t:
                continue
            data, at, number = t.encode(), 0, 0
            while at <= len(data):
                stop = len(data) if len(data) - at <= PART_BYTES else data.find(b"\n", at + PART_BYTES)
                stop = len(data) if stop < 0 else stop
                piece = data[at:stop]
                held.append((i, number, piece))
                size += len(piece) + 1
                number += piece.count(b"\n") + 1
                at = stop + 1
                if size >= PART_BYTES:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def __call__(self, part: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, line of each hash, and text and number of each line."""
        data = np.frombuffer(b"\n".join(p for _, _, p in part).translate(_FOLD), np.uint8)
        self._powers(len(data) + 1)
        breaks = np.flatnonzero(data == 10)
        n_lines = np.array([p.count(b"\n") + 1 for _, _, p in part], np.int64)
        text = np.repeat(np.array([i for i, _, _ in part], np.int64), n_lines)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_lines) - n_lines - np.array([k for _, k, _ in part], np.int64), n_lines)
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = (data == 32) | (data == 10)
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        begin, end = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=total[1:])
        h = _mix((total[end] - total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))
        return h, np.searchsorted(breaks, begin), text, number


def token_counts(docs: DataFrame, tokens: _Tokens | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all tokens by hash bucket, and a bit map of the buckets (many more) that two uses fall in."""
    tokens = tokens or _Tokens()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        once, twice = np.zeros(1 << TWICE_BITS, bool), np.zeros(1 << TWICE_BITS, bool)
        for part in (p for batch in it for p in tokens.parts(batch.column(0).to_pylist())):
            h = np.sort(tokens(part)[0])
            if not len(h):
                continue
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            u, c = h[first], np.diff(np.r_[first, len(h)])
            counts += np.bincount((u >> np.uint64(64 - COUNT_BITS)).astype(np.int64), c, 1 << COUNT_BITS).astype(np.int64)
            at = (u & np.uint64((1 << TWICE_BITS) - 1)).astype(np.int64)
            twice[at[(c > 1) | once[at]]] = True
            at.sort()
            twice[at[1:][at[1:] == at[:-1]]] = True
            once[at] = True
        parts = [np.split(x, SLICES) for x in (counts.astype(np.float64), np.packbits(once), np.packbits(twice))]
        columns = [pa.array([x.tobytes() for x in p], pa.binary()) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), *columns], ["slice", "counts", "once", "twice"])

    def add(a: list[bytes], b: list[bytes]) -> list[bytes]:
        (n, o, t), (m, p, u) = ([np.frombuffer(x[0]), *(np.frombuffer(y, np.uint8) for y in x[1:])] for x in (a, b))
        return [(n + m).tobytes(), (o | p).tobytes(), (t | u | o & p).tobytes()]

    out = merged(docs.select("text").mapInArrow(run, "slice int, counts binary, once binary, twice binary"), add)
    if not out:
        return np.zeros(1 << COUNT_BITS), np.zeros(1 << TWICE_BITS - 3, np.uint8)
    return np.concatenate([np.frombuffer(x[0]) for x in out]), np.concatenate([np.frombuffer(x[2], np.uint8) for x in out])


class _Sets:
    """Lines of a part of a batch as sets, ordered by rarity. Arrays by line: set and twin (the halves of its name), size,
    parity, text, number; by token: token, rarity, line, place (in its line's order)."""

    def __init__(self, tokens: _Tokens, part: list[tuple[int, int, bytes]], counts: np.ndarray, min_words: int):
        h, line, text, number = tokens(part)
        u, own = np.unique(h, return_inverse=True)
        rarity = counts[(u >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        order = np.lexsort((u, rarity))
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        key = np.sort(line * len(u) + rank[own])
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        line = key // max(1, len(u))
        token = order[key - line * len(u)]
        size = np.bincount(line, minlength=len(text))
        keep = size >= min_words
        on = keep[line]
        token = token[on]
        self.token, self.rarity, self.line = u[token], rarity[token], (np.cumsum(keep) - 1)[line[on]]
        self.size, self.text, self.number = size[keep], text[keep], number[keep]
        self.start = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.token)) - self.start[self.line]
        if len(self.size):
            self.set = np.add.reduceat(_mix(self.token), self.start).view(np.int64)
            self.parity = _parities(self.token, self.start)
        else:
            self.set = self.parity = np.zeros(0, np.int64)

    def twin(self) -> np.ndarray:
        return np.add.reduceat(_mix(self.token, 0xD6E8FEB86659FD93), self.start).view(np.int64) if len(self.size) else np.zeros(0, np.int64)


def _parities(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(np.uint64(1) << (token >> np.uint64(8) & np.uint64(63)), start).view(np.int64)


def _least_overlap(size: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def _pairs_of_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def index_rows(docs: DataFrame, threshold: float, min_words: int, counts, twice, tokens: _Tokens | None = None) -> DataFrame:
    """(key, set, parity, form): the indexed tokens of each task's distinct sets. form holds the size, the token's place
    in 31 bits each and, as its sign, whether the task has the set more than once."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, twice))  # fixed sizes
    tokens = tokens or _Tokens()

    def flush(held: list[tuple]) -> pa.RecordBatch:
        name, size, parity = (np.concatenate([h[k] for h in held]) for k in range(3))
        _, chosen, again = np.unique(name, return_index=True, return_counts=True)
        often = np.zeros(len(name), bool)
        often[chosen] = again > 1
        first = np.zeros(len(name), bool)
        first[chosen] = True
        base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        line = np.concatenate([h[3] + b for h, b in zip(held, base, strict=True)])
        key, place = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
        on = first[line]
        line, key, place = line[on], key[on], place[on]
        form = size[line] << 31 | place
        columns = [key.view(np.int64), name[line], parity[line], np.where(often[line], -form - 1, form)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "set", "parity", "form"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, twice = shared.value
        twice = np.unpackbits(twice).view(bool)
        held, lines, entries = [], 0, 0
        # A bucket holds many tokens, so what it has beyond the mean tells whether one of them is common.
        common = counts.mean() + max(COMMON, counts.mean()) if COMMON else 0
        for part in (p for batch in it for p in tokens.parts(batch.column(0).to_pylist())):
            s = _Sets(tokens, part, counts, min_words)
            if not len(s.size):
                continue
            reach = (s.size - _least_overlap(s.size, threshold))[s.line]  # the last place of the prefix
            near = np.flatnonzero(s.place <= reach)
            near = near[twice[(s.token[near] & np.uint64((1 << TWICE_BITS) - 1)).astype(np.int64)]]
            alone = (s.rarity[near] <= common) | (s.size[s.line[near]] == 1)  # a set of one token has no second one
            rare, often = near[alone], near[~alone]
            lines_, keys, places = [s.line[rare]], [s.token[rare]], [s.place[rare]]
            step = 1
            while len(often):  # a common token goes with each later token of the prefix, which is one longer
                second = often + step
                ok = second < len(s.token)
                often, second = often[ok], second[ok]
                ok = (s.line[second] == s.line[often]) & (s.place[second] <= reach[often] + 1)
                often, second = often[ok], second[ok]
                lines_.append(s.line[often])
                keys.append(_pairs_of_hashes(s.token[often], s.token[second]))
                places.append(s.place[often])
                step += 1
            held.append((s.set, s.size, s.parity, np.concatenate(lines_), np.concatenate(keys), np.concatenate(places)))
            lines += len(s.size)
            entries += len(held[-1][4])
            if lines > 100_000 or entries > 1_000_000:
                yield flush(held)
                held, lines, entries = [], 0, 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(run, "key long, set long, parity long, form long")


def _runs(it: Iterator[pa.RecordBatch], handle) -> Iterator[pa.RecordBatch]:
    """handle(columns of complete runs of equal first columns) over sorted batches."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def whole() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for batch in it:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if (rows < ROWS_AT_ONCE and size < RUN_BYTES) or batch.column(0)[-1].as_py() == held[0].column(0)[0].as_py():
            continue
        t = whole()
        keys = t.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield from handle(t.slice(0, cut))
        held = t.slice(cut).to_batches()
        rows, size = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if held:
        yield from handle(whole())


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ... in one array."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def _groups(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose n sum up to about most."""
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def _linked(name: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rows (smallest name of the component, name) of the names that the pairs (i, j) link."""
    label = name.copy()
    while True:
        before = label[i].copy(), label[j].copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if (label[i] == before[0]).all() and (label[j] == before[1]).all():
            break
    rows = np.unique(np.concatenate([i, j]))
    return np.unique(np.stack([label[rows], name[rows]], axis=1), axis=0)


def candidates(index: DataFrame, threshold: float) -> DataFrame:
    """(cluster, set): sets that occur again (cluster null), and the sets under a key that may be similar to another one
    there. A cluster holds what is linked by such pairs under one key and is named by its smallest set."""
    ratio = threshold / (1 + threshold)

    def handle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, name, parity, form = (t.column(c).to_numpy() for c in ("key", "set", "parity", "form"))
        repeated = form < 0
        form = np.where(repeated, -form - 1, form)
        order = np.lexsort((name, form >> 31, key))
        key, name, parity, form, repeated = (x[order] for x in (key, name, parity.view(np.uint64), form, repeated))
        new = np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])]
        again = np.unique(name[repeated | ~new])
        key, name, parity, form = (x[new] for x in (key, name, parity, form))
        size, place = form >> 31, form & (1 << 31) - 1
        run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        # The smaller set of a pair is the one in front; its shorter prefix is enough, and its partners end where sizes do.
        span = int(size.max()) * 2 + 2
        ends = np.searchsorted(run * span + size, run * span + np.floor(size / threshold + 1e-9).astype(np.int64), side="right")
        n = np.where(place <= size - np.ceil(2 * ratio * size - 1e-9), ends - np.arange(len(size)) - 1, 0)
        left = np.flatnonzero(n > 0)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _groups(n[left], PAIRS_AT_ONCE):
            i, j = np.repeat(left[part], n[left[part]]), _ranges(left[part] + 1, n[left[part]])
            both = size[i] + size[j]
            need = np.ceil(ratio * both - 1e-9)
            ok = (np.minimum(size[i] - place[i], size[j] - place[j]) >= need) & (np.bitwise_count(parity[i] ^ parity[j]) <= both - 2 * need)
            first.append(i[ok])
            second.append(j[ok])
        i, j = np.concatenate(first), np.concatenate(second)
        pairs = _linked(name, i, j)
        clusters = pa.array(np.concatenate([np.zeros(len(again), np.int64), pairs[:, 0]]), mask=np.arange(len(again) + len(pairs)) < len(again))
        yield pa.RecordBatch.from_arrays([clusters, pa.array(np.concatenate([again, pairs[:, 1]]))], ["cluster", "set"])

    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda it: _runs(it, handle), "cluster long, set long")


def dealt(clusters: DataFrame) -> DataFrame:
    """(task, set): the tasks in which the sets of a cluster meet. A cluster of up to CLUSTER_ROWS is one task; of a larger
    one every pair of its blocks is, and a set goes to all tasks of its block."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = clusters.join(sizes, "cluster").withColumn("b", F.ceil(F.col("n") / CLUSTER_ROWS).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set"), F.col("b")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    task = F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(F.when(F.col("b") > 1, task).otherwise(F.col("cluster")).alias("task"), "set")


def _signatures(token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """512 parity bits of each set, as eight words."""
    h = _mix(token, 0xA0761D6478BD642F)
    word, bit = h >> np.uint64(61), np.uint64(1) << (h >> np.uint64(50) & np.uint64(63))
    return np.stack([np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), start) for k in range(8)], axis=1)


def signed(lines: DataFrame) -> DataFrame:
    """(set, size, signature) of the lines that carry tokens."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                tokens = batch.column("tokens").to_pylist()
                size = np.array([len(x) // 8 for x in tokens], np.int64)
                sig = _signatures(np.frombuffer(b"".join(tokens), np.uint64), np.cumsum(size) - size)
                yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array(size), pa.array([x.tobytes() for x in sig], pa.binary())], ["set", "size", "signature"])

    return lines.where("tokens is not null").select("set", "tokens").mapInArrow(run, "set long, size long, signature binary")


def refined(pool: DataFrame, threshold: float) -> DataFrame:
    """(cluster, set) as candidates gives them, of the sets of pool (task, set, size, signature) whose signatures differ
    from another one's in the task by no more bits than similar sets have tokens apart."""
    ratio = threshold / (1 + threshold)

    def handle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        task, name, size = (t.column(c).to_numpy() for c in ("task", "set", "size"))
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint64).reshape(-1, 8)
        order = np.lexsort((name, size, task))
        task, name, size, sig = task[order], name[order], size[order], sig[order]
        # The signature of a set may have come from several tasks.
        new = np.r_[True, (np.diff(task) != 0) | (np.diff(name) != 0) | (np.diff(size) != 0) | (sig[1:] != sig[:-1]).any(axis=1)]
        task, name, size, sig = task[new], name[new], size[new], sig[new]
        run = np.cumsum(np.r_[True, task[1:] != task[:-1]]) - 1
        span = int(size.max()) * 2 + 2
        n = np.searchsorted(run * span + size, run * span + np.floor(size / threshold + 1e-9).astype(np.int64), side="right") - np.arange(len(size)) - 1
        left = np.flatnonzero(n > 0)
        first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _groups(n[left], PAIRS_AT_ONCE):
            i, j = np.repeat(left[part], n[left[part]]), _ranges(left[part] + 1, n[left[part]])
            both = size[i] + size[j]
            most = both - 2 * np.ceil(ratio * both - 1e-9).astype(np.int64)
            apart = np.zeros(len(i), np.int64)
            for k in range(8):
                apart += np.bitwise_count(sig[i, k] ^ sig[j, k])
                ok = apart <= most
                if not ok.all():
                    i, j, most, apart = i[ok], j[ok], most[ok], apart[ok]
            first.append(i)
            second.append(j)
        pairs = _linked(name, np.concatenate(first), np.concatenate(second))
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["cluster", "set"])

    n = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pool.select("task", "set", "size", "signature")
    return rows.repartition(n, "task").sortWithinPartitions("task").mapInArrow(lambda it: _runs(it, handle), "cluster long, set long")


def matches(pool: DataFrame, threshold: float) -> DataFrame:
    """(set, twin): the sets of pool (task, set, twin, ord, line, tokens) that have a similar one in a task at an earlier
    position. In round r the r-th set of every task, by position, is compared with all later ones that have no match yet."""
    ratio = threshold / (1 + threshold)

    def compare(task, order, line, tokens) -> np.ndarray:
        size = np.array([len(x) // 8 for x in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint64)
        start = np.cumsum(size) - size
        parity = _parities(flat, start).view(np.uint64)
        _, word = np.unique(flat, return_inverse=True)
        run = np.cumsum(np.r_[True, task[1:] != task[:-1]]) - 1
        begin = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
        count = np.diff(np.r_[begin, len(task)])
        word = word + np.repeat(run, size) * (int(word.max()) + 1)
        hit = np.zeros(len(task), bool)
        live = np.arange(len(task))
        r = 0
        while len(live):
            lead = begin[run[live]] + r
            live = live[lead < live] if r == 0 else live[~hit[live] & (lead < live)]
            lead = begin[run[live]] + r
            both = size[live] + size[lead]
            need = np.ceil(ratio * both - 1e-9)
            fits = (np.minimum(size[live], size[lead]) >= need) & (np.bitwise_count(parity[live] ^ parity[lead]) <= both - 2 * need)
            fits &= (order[lead] < order[live]) | (line[lead] < line[live])
            a, b, need = live[fits], lead[fits], need[fits]
            for part in _groups(size[a], TOKENS_AT_ONCE):
                x, leaders = a[part], np.unique(b[part])
                held = np.sort(word[_ranges(start[leaders], size[leaders])])
                mine = word[_ranges(start[x], size[x])]
                at = np.minimum(np.searchsorted(held, mine), len(held) - 1)
                shared = np.add.reduceat((held[at] == mine).astype(np.int64), np.cumsum(size[x]) - size[x])
                hit[x[shared >= need[part]]] = True
            r += 1
            live = live[~hit[live] & (count[run[live]] > r)]
        return hit

    def handle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        task, order, line = (t.column(c).to_numpy() for c in ("task", "ord", "line"))
        name, twin = (t.column(c).to_numpy() for c in ("set", "twin"))
        by = np.lexsort((twin, name, line, order, task))
        # The tokens of a set may have come from several tasks.
        by = by[np.r_[True, (np.diff(task[by]) != 0) | (np.diff(name[by]) != 0) | (np.diff(twin[by]) != 0)]]
        tokens = t.column("tokens").to_pylist()
        hit = by[compare(task[by], order[by], line[by], [tokens[k] for k in by.tolist()])]
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(hit)) for c in ("set", "twin")], ["set", "twin"])

    n = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pool.select("task", "set", "twin", "ord", "line", "tokens")
    return rows.repartition(n, "task").sortWithinPartitions("task").mapInArrow(lambda it: _runs(it, handle), "set long, twin long")


def lines_of(docs: DataFrame, wanted: Bloom, compared: Bloom, min_words: int, counts) -> DataFrame:
    """(id, ord, text_hash, line, set, twin, tokens) of the lines whose sets may be wanted; tokens only of sets that may have
    to be compared, and about once in a task."""
    shared = docs.sparkSession.sparkContext.broadcast((wanted, compared, counts))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, compared, counts = shared.value
        tokens, given = _Tokens(), set()
        for batch in it:
            for part in tokens.parts(batch.column("text").to_pylist()):
                s = _Sets(tokens, part, counts, min_words)
                hit = np.flatnonzero(wanted.test(s.set)) if len(s.set) else np.zeros(0, np.int64)
                twin, new = s.twin()[hit], compared.test(s.set[hit])
                for k in np.flatnonzero(new).tolist():
                    if (name := (int(s.set[hit[k]]), int(twin[k]))) in given:
                        new[k] = False
                    given.add(name)
                if len(given) > 500_000:
                    given.clear()
                data = [s.token[a : a + n].tobytes() if f else None for a, n, f in zip(s.start[hit].tolist(), s.size[hit].tolist(), new.tolist(), strict=True)]
                rows = pa.array(s.text[hit])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(rows) for c in ("id", "ord", "text_hash")), pa.array(s.number[hit]), pa.array(s.set[hit]), pa.array(twin), pa.array(data, pa.binary())],
                    ["id", "ord", "text_hash", "line", "set", "twin", "tokens"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "ord", "text_hash", "text").mapInArrow(run, f"id {kind}, ord long, text_hash long, line long, set long, twin long, tokens binary")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """(id, text_hash, removed): numbers of the lines that go, for each document that loses any. A line goes if it is not
    the first of its set or if its set has a similar one that is first found earlier."""
    id_type = docs.schema[id_col].dataType
    whole = isinstance(id_type, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    order = docs[id_col].cast("long") if whole else F.when(docs[id_col].isNotNull(), F.xxhash64(docs[id_col].cast("string")))
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(order, F.lit(-(1 << 63))).alias("ord"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text")
    ).where(F.col("text").isNotNull())
    counts, twice = token_counts(rows)
    found = materialize(candidates(index_rows(rows, threshold, min_words, counts, twice), threshold).distinct())
    clusters = found.where("cluster is not null")
    lines = materialize(lines_of(rows, Bloom.of(found.select("set")), Bloom.of(clusters.select("set")), min_words, counts))
    # Signatures of 64 bytes first tell more closely which sets may be similar, and only the tokens of these travel.
    closer = materialize(refined(signed(lines).join(dealt(clusters), "set"), threshold).distinct())
    first = materialize(lines.groupBy("set", "twin").agg(F.min(F.struct("ord", "line")).alias("p")).select("set", "twin", "p.ord", "p.line"))
    # Tokens travel twice, once to learn their tasks and once to these.
    info = first.join(dealt(closer), "set")
    pool = lines.where("tokens is not null").select("set", "twin", "tokens").join(info, ["set", "twin"])
    hits = matches(pool, threshold).distinct().withColumn("hit", F.lit(True))
    # A written table, so that the join with the lines, in which one set may be very frequent, can be split.
    decided = materialize(first.join(hits, ["set", "twin"], "left").select("set", "twin", F.col("ord").alias("o"), F.col("line").alias("l"), F.coalesce("hit", F.lit(False)).alias("hit")))
    late = lines.drop("tokens").join(decided, ["set", "twin"]).where("hit OR o < ord OR (o = ord AND l < line)")
    return late.groupBy("id", "text_hash").agg(F.collect_set(F.col("line").cast("int")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, min_words: int = 5) -> DataFrame:
    """docs with the removed lines taken out of the text, and the columns n_lines and n_removed (longs) at the end. Other
    columns stay as they are; the rest of a text keeps its order and its line breaks."""
    gone = materialize(removals(docs, id_col, text_col, threshold, min_words)).toDF("__id", "__hash", "__removed")
    # Texts that lose nothing, as a filter of fixed size tells, are not shuffled.
    shared = docs.sparkSession.sparkContext.broadcast(Bloom.of(gone.select(F.xxhash64("__id", "__hash").alias("k"))))
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    rows = docs.toDF(*names)
    rows = rows.withColumn("__text_hash", F.xxhash64(text)).withColumn("__k", F.xxhash64(own, "__text_hash"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            may = shared.value.test(batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], [*batch.schema.names[:-1], "__may"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    rows = rows.mapInArrow(run, f"{schema}, __text_hash long, __may boolean")
    losing = rows.where("__may").join(gone, rows[own].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").select(*names, "__removed")
    whole = rows.where("NOT __may").select(*names, F.lit(None).cast("array<int>").alias("__removed"))
    parts = F.split(text, "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains("__removed", i))
    rest = F.when(F.col("__removed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")
    columns = [rest if n == text else F.col(n) for n in names]
    out = losing.unionByName(whole).select(*columns, n_lines, F.coalesce(F.size("__removed"), F.lit(0)).cast("long"))
    out = out.toDF(*names, "n_lines", "n_removed")
    clear = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c not in ("n_lines", "n_removed")]
    return out.select(*(F.col(n).alias(c) for n, c in clear), "n_lines", "n_removed")
