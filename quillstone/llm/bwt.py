"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

A collection of strings, each with an end mark, is cut into shards. Every shard sorts its own suffixes by their first
`depth` symbols and keeps, for each, the symbols before it: its transform. The shards are merged without sorting
suffixes again. The interleave says, for each place in the merged order, which shard the suffix there is from. It begins
as the shards one after the other, in order by no symbol at all. If it is in order by h symbols, then reading the
transforms through it and sorting its places, stably, by the symbols read puts it in order by h + q symbols, q being the
symbols read at once. Places where two neighbours come to differ are where the common prefix ends: the round in which
that happens bounds its length, and intervals without such a place after `depth` symbols are the repeats of that length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: End mark: no byte of UTF-8.
END = 0xFF


@dataclass
class Shard:
    string: np.ndarray  # string of each sorted suffix
    place: np.ndarray  # its place in the string
    before: dict[int, np.ndarray]  # q -> the q symbols before it, as one number


def shard(strings: list[bytes], numbers: np.ndarray, depth: int, steps: tuple[int, ...]) -> Shard:
    """Sorted suffixes (as rotations of the string and its end mark) and transforms of a shard. numbers: the strings'
    numbers in the collection."""
    mark = bytes([END])
    wrapped = []
    for s in strings:
        loop = s + mark
        tail = loop if len(loop) >= depth else loop * (depth // len(loop) + 1)
        wrapped.append(loop + tail[:depth])
    size = np.array([len(s) + 1 for s in strings], np.int64)
    start = np.cumsum(size + depth) - (size + depth)
    data = np.frombuffer(b"".join(wrapped) + bytes(8), np.uint8)
    owner = np.repeat(np.arange(len(strings)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = start[owner] + place
    windows = np.ndarray((len(data) - 8 - depth + 1,), f"S{depth}", data, strides=(1,))
    order = np.argsort(windows[at], kind="stable")
    owner, place = owner[order], place[order]
    eight = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))  # the eight bytes from each place on
    before = {}
    for q in steps:
        ahead = start[owner] + (place - q) % size[owner]
        before[q] = eight[ahead].astype(np.uint64) >> np.uint64(64 - 8 * q)
    return Shard(numbers[owner], place, before)


@dataclass
class Merged:
    string: np.ndarray
    place: np.ndarray
    common: np.ndarray  # with the suffix before: a lower bound that is exact up to the last step, or depth
    repeat: np.ndarray  # number of the interval of suffixes that agree in depth symbols


def _ranks(codes: np.ndarray, q: int) -> np.ndarray | None:
    """Codes as 16-bit numbers in the same order, or None if there are too many different ones."""
    if q < 3:
        return codes.astype(np.uint16)
    values, rank = np.unique(codes, return_inverse=True)
    return rank.astype(np.uint16) if len(values) <= 1 << 16 else None


def merge(shards: list[Shard], depth: int) -> Merged:
    string, place = (np.concatenate([getattr(s, k) for s in shards]) for k in ("string", "place"))
    which = np.repeat(np.arange(len(shards)), [len(s.string) for s in shards]).astype(np.uint8)
    n = len(which)
    for q in sorted((q for q in shards[0].before if q in STEPS), reverse=True):
        if (read := _ranks(np.concatenate([s.before[q] for s in shards]), q)) is not None:
            break
    plan = [depth % q] * bool(depth % q) + [q] * (depth // q)
    rows = np.arange(n, dtype=np.int32)
    at = np.empty(n, np.int32)
    block = np.zeros(n, np.int32)
    common = np.full(n, -1, np.int16)
    done = 0
    for step in plan:
        transform = read if step == q else _ranks(np.concatenate([s.before[step] for s in shards]), step)
        at[np.argsort(which, kind="stable")] = rows  # the j-th place of a shard is its j-th row
        symbol = transform[at]
        order = np.argsort(symbol, kind="stable")
        which, symbol, block = which[order], symbol[order], block[order]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        common[new & (common < 0)] = done
        block = np.cumsum(new, dtype=np.int32)
        done += step
    at[np.argsort(which, kind="stable")] = rows
    common[common < 0] = depth
    return Merged(string[at], place[at], common, block)


#: Symbols read at once: as many as have at most 2^16 different values in a batch.
STEPS = (8, 6, 4, 2)


def repeats(strings: list[bytes], depth: int, shard_bytes: int = 1 << 14) -> list[np.ndarray]:
    """For each string, at which places a substring of `depth` bytes begins that also begins somewhere else in the
    collection (or elsewhere in the string). Strings are dealt to shards in turn."""
    total = sum(map(len, strings))
    k = int(min(max(2, -(-total // shard_bytes)), 255, max(1, len(strings))))
    numbers = [np.arange(i, len(strings), k) for i in range(k)]
    steps = tuple({q: None for w in STEPS for q in (w, depth % w) if q})
    found = merge([shard([strings[i] for i in own.tolist()], own, depth, steps) for own in numbers], depth)
    size = np.array([len(s) for s in strings])
    valid = np.flatnonzero(found.place <= size[found.string] - depth)
    interval = found.repeat[valid]
    mark = valid[np.bincount(interval, minlength=len(found.repeat) + 2)[interval] > 1]
    string, place = found.string[mark], found.place[mark]
    order = np.argsort(string, kind="stable")
    cuts = np.searchsorted(string[order], np.arange(len(strings) + 1))
    return [np.sort(place[order][a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
