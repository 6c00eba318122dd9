"""Packing of token sequences by cutting-stock column generation.

Every document is cut into full sequences and one rest, so the corpus is described by how many pieces it has of each
length from 1 to the sequence size: a histogram whose size does not grow with the data. Its lengths are gathered in at most
`rows` classes of about equal token counts (each length is its own class where there are fewer), and a linear program over
patterns (how many pieces of each class, taken at the class's greatest length, share a sequence) is solved by column
generation: it starts from patterns of one class, a knapsack dynamic program prices patterns against the dual prices, and
the revised simplex brings the worthy ones in until none is left. The pattern counts are rounded, and each pattern is
filled with exact lengths: its classes give their longest pieces, and the room that is left at the end, known exactly then,
takes the longest pieces that fit it. What the patterns leave is packed greedily, and the pieces of each length, ranked,
take the pattern slots of that length in order.

Defined cases: null text is the empty text (only the end id); runs of white space or of letters may be of any length; ids that are null or repeated are carried along, as ranks
count rows, not ids; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.bpe import PRETOKEN, byte_alphabet, encoder
from quillstone.llm.common import stored, texts_of


@lru_cache(maxsize=4)
def _library_encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary file in a faster library: a token's id is its merge rank, so the ids are the same."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)


#: Runs beyond which the faster library's stack or time may not do; texts that have one go to our own encoder, whose time
#: is in proportion to the text.
_LONG_RUN = re.compile(r"\s{4096}|\S{65536}")


def token_ids(path: str) -> Callable[[str], list[int]]:
    library = _library_encoder(path)

    def ids(text: str) -> list[int]:
        if len(text) >= 4096 and _LONG_RUN.search(text):
            return np.frombuffer(encoder(path).encode_packed(text), np.uint32).tolist()
        return library.encode(text, allowed_special="all", disallowed_special=())

    return ids


@dataclass
class Plan:
    """Patterns as (lengths, times), the linear program's value, a lower bound on the number of sequences, the rounds of
    pricing, the columns that entered, and the sequences that the priced patterns fill; greedy packing fills the others."""

    patterns: list[tuple[np.ndarray, int]]
    value: float
    bound: float
    rounds: int
    entered: int = 0
    from_patterns: int = 0


def _greedy(counts: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """Fill a sequence with the largest pieces that fit, use that pattern as often as the pieces allow, and go on: every
    pattern uses some length up, so there are at most as many patterns as lengths."""
    left, out = counts.astype(np.int64).copy(), []
    while len(open_lengths := np.flatnonzero(left)):
        room, pattern = size, []
        while room and (k := int(np.searchsorted(open_lengths, room, side="right"))):
            length = int(open_lengths[k - 1])
            take = min(room // length, int(left[length]))
            pattern.append((length, take))
            room -= take * length
            open_lengths = open_lengths[: k - 1]
        times = min(int(left[length]) // take for length, take in pattern)
        for length, take in pattern:
            left[length] -= take * times
        out.append((np.repeat([x for x, _ in pattern], [n for _, n in pattern]), times))
    return out


def _knapsack(lengths: np.ndarray, prices: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c] = max over lengths l <= c of best[c - l] + price(l), the worth of the best pattern within c, and the last
    length of that pattern (-1: none)."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(1, size + 1):
        if k := upto[c]:
            gain = best[c - lengths[:k]] + prices[:k]
            i = int(gain.argmax())
            if gain[i] > 0:
                best[c], last[c] = gain[i], i
    return best, last


def _traced(lengths: np.ndarray, last: np.ndarray, room: int) -> np.ndarray:
    pattern = np.zeros(len(lengths), np.int64)
    while room > 0 and last[room] >= 0:
        pattern[last[room]] += 1
        room -= int(lengths[last[room]])
    return pattern


def generate(lengths: np.ndarray, demand: np.ndarray, size: int, columns_a_round: int = 16, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The linear program min sum(x), patterns @ x = demand, by column generation: (basis of patterns as columns, x,
    rounds, columns that entered). It ends when no pattern's worth exceeds its cost, or when the value meets the lower
    bound of the dual prices."""
    m, fit = len(lengths), size // lengths
    basis, inverse = np.diag(fit), np.diag(1.0 / fit)
    x, prices = demand / fit, 1.0 / fit
    bound, rounds, entered, worth_one = float((lengths * demand).sum()) / size, 0, 0, 1 + tolerance
    while True:
        best, last = _knapsack(lengths, prices, size)
        bound = max(bound, float((prices * demand).sum()) / max(float(best[size]), 1.0))
        if best[size] <= worth_one or x.sum() <= bound * worth_one:
            return basis, np.maximum(x, 0), rounds, entered
        rounds += 1
        worth = prices + best[size - lengths]  # of the best pattern that holds each length
        moved = False
        for i in np.argsort(-worth, kind="stable")[:columns_a_round].tolist():
            if worth[i] <= worth_one:
                break
            pattern = _traced(lengths, last, size - int(lengths[i]))
            pattern[i] += 1
            if (prices * pattern).sum() <= worth_one:  # the columns before it have changed the prices
                continue
            on = np.flatnonzero(pattern)
            step = (inverse[:, on] * pattern[on]).sum(axis=1)
            ratio = np.full(m, np.inf)
            ratio[step > 1e-9] = np.maximum(x[step > 1e-9], 0) / step[step > 1e-9]
            out = int(ratio.argmin())
            row, x = inverse[out] / step[out], x - ratio[out] * step
            x[out] = ratio[out]
            step[out] -= 1
            inverse -= step[:, None] * row[None, :]
            prices = prices - step.sum() * row
            basis[:, out] = pattern
            entered += 1
            moved = moved or ratio[out] > 0
        if rounds % 64 == 0 or not moved:  # rounding errors do not add up
            x, prices = (inverse * demand).sum(axis=1), inverse.sum(axis=0)
        if rounds >= 200 * m:  # a cycle of degenerate steps; every basis is a whole plan
            return basis, np.maximum(x, 0), rounds, entered


def classes(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(greatest length of each class, class of each length that occurs)."""
    lengths = np.flatnonzero(counts[1:]) + 1
    if len(lengths) <= rows:
        return lengths, np.arange(len(lengths))
    tokens = np.cumsum((counts[lengths] * lengths).astype(float))
    last = np.unique(np.minimum(np.searchsorted(tokens, tokens[-1] * np.arange(1, rows + 1) / rows * (1 - 1e-12)), len(lengths) - 1))
    return lengths[last], np.searchsorted(lengths[last], lengths)


def _filled(left: np.ndarray, pattern: np.ndarray, edges: np.ndarray, times: int, size: int) -> list[tuple[np.ndarray, int]]:
    """The pattern, at most `times` times, in exact lengths; left is reduced. All places but the last take the longest
    piece up to their class's greatest length; then the longest pieces that fit the room follow. Where more room would be left
    than the pattern itself leaves, and than 1/1024 of the sequence, the pattern is not used further."""
    out = []
    places = np.repeat(edges, pattern)[::-1].tolist()
    slack = max(size - sum(places), size // 1024)
    least = int(edges[np.searchsorted(edges, places[0]) - 1]) if places[0] > edges[0] else 0
    while times:
        free, chosen, room = left.copy(), [], size
        open_ = np.flatnonzero(free)
        for most in [*places[:-1], *([size] * size)]:
            k = int(np.searchsorted(open_, min(most, room), side="right"))
            if not k:
                break
            length = int(open_[k - 1])
            if not chosen and len(places) > 1 and length <= least:  # the class is used up
                return out
            chosen.append(length)
            room -= length
            free[length] -= 1
            if not free[length]:
                open_ = np.delete(open_, k - 1)
        if not chosen or room > slack:
            return out
        used = np.bincount(chosen, minlength=len(left))
        on = np.flatnonzero(used)
        n = min(times, int((left[on] // used[on]).min()))
        left -= used * n
        times -= n
        out.append((np.sort(np.array(chosen, np.int64))[::-1], n))
    return out


def solve(counts: np.ndarray, size: int, rows: int = 96) -> Plan:
    """Pattern plan for counts[l] pieces of length l (0 <= l <= size)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    if not left.any():
        return Plan([], 0.0, 0.0, 0)
    material = float((left * np.arange(len(left))).sum()) / size
    edges, own = classes(left, rows)
    demand = np.bincount(own, left[left > 0], len(edges))
    basis, x, rounds, entered = generate(edges, demand, size)
    # Rounded down, then once more in the order of the fractions as long as the classes have the pieces.
    times = np.floor(x + 1e-7).astype(np.int64)
    spare = demand - (basis * times).sum(axis=1)
    for j in np.argsort(times - x, kind="stable").tolist():
        if x[j] - times[j] > 1e-7 and (basis[:, j] <= spare + 1e-7).all():
            times[j] += 1
            spare = spare - basis[:, j]
    order = sorted(np.flatnonzero(times).tolist(), key=lambda j: -int(np.flatnonzero(basis[:, j])[-1]))
    patterns = [p for j in order for p in _filled(left, basis[:, j], edges, int(times[j]), size)]
    return Plan(patterns + _greedy(left, size), float(x.sum()), material, rounds, entered, sum(n for _, n in patterns))


def slots(plan: Plan) -> tuple[np.ndarray, ...]:
    """(length, first rank, first sequence, offset) of each slot block, ordered by length and rank. A block holds the
    slots of one position of one pattern: the rank r of a length in it goes to sequence first + (r - first rank)."""
    length, first, offset, times, base = [], [], [], [], 0
    for pattern, n in plan.patterns:
        ends = np.cumsum(pattern)
        length.extend(pattern)
        offset.extend(ends - pattern)
        first.extend([base] * len(pattern))
        times.extend([n] * len(pattern))
        base += n
    length, first, offset, times = (np.array(v, np.int64) for v in (length, first, offset, times))
    order = np.argsort(length, kind="stable")
    length, first, offset, times = length[order], first[order], offset[order], times[order]
    before = np.cumsum(times) - times
    new = np.r_[True, length[1:] != length[:-1]] if len(length) else np.zeros(0, bool)
    rank = before - np.maximum.accumulate(np.where(new, before, 0))
    return length, rank, first, offset


def pieces(docs: DataFrame, ids_of: Callable[[], Callable[[str], list[int]]], end_id: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's pieces: full ones, then one rest. rank counts the pieces of a length within a task's rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = ids_of(), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in it:
            row, start, length, crc, total, rank = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                ids = np.array([*encode(text), end_id], "<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    row.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    rank.append(seen[len(part)])
                    seen[len(part)] += 1
            values = [pa.array(v, pa.int64()) for v in (start, length, crc, total, rank)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *values, pa.array([task] * len(row), pa.int32())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "rank", "task"],
            )

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, rank long, task int")


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    The pieces are written once (a few numbers each). Only the histogram, at most `size` rows, reaches the driver, and
    only the slot blocks of its patterns go back. A length that a third of all pieces share is ranked task by task: the
    window runs over (length, task) counts, never over pieces."""
    found = stored(pieces(docs, lambda: token_ids(vocabulary), end_id, size, id_col, text_col))
    per_task = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    block_length, block_rank, block_first, block_offset = slots(solve(counts, size))
    below = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    key = block_length * (1 << 44) + block_rank

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(block_first[at] + rank - block_rank[at]), pa.array(block_offset[at])],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = found.schema["id"].dataType.simpleString()
    ranked = found.join(before, ["length", "task"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")
    )
    out = ranked.mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
