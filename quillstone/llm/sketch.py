"""Sketches of a fixed size, built by tasks and merged slice by slice on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64


def merged(parts: DataFrame, merge) -> list[list[bytes]]:
    """parts has (slice int, one or more binary columns); all rows of a slice are merged pairwise by
    merge(list of bytes, list of bytes), in a stream, and the merged slices come back in order."""
    names = [c for c in parts.columns if c != "slice"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in it:
            for k, *data in zip(*(batch.column(c).to_pylist() for c in ["slice", *names]), strict=True):
                held[k] = merge(held[k], data) if k in held else data
        columns = [pa.array([v[i] for v in held.values()], pa.binary()) for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *columns], ["slice", *names])

    out = parts.repartition(SLICES, "slice").mapInArrow(run, "slice int, " + ", ".join(f"{c} binary" for c in names)).collect()
    return [[bytes(r[c]) for c in names] for r in sorted(out, key=lambda r: r["slice"])]


def _either(a: list[bytes], b: list[bytes]) -> list[bytes]:
    return [(np.frombuffer(x, np.uint8) | np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)]


class Bloom:
    """Set of 64-bit hashes in 2^bits bits with two probes. It can only say too often that a value may be in the set."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    @staticmethod
    def _probes(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        v = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        w = (v ^ v >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return (v >> np.uint64(64 - bits)).astype(np.int64), (w >> np.uint64(64 - bits)).astype(np.int64)

    def __contains__(self, value: int) -> bool:
        return bool(self.test(np.array([value], np.int64))[0])

    def test(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for p in self._probes(values, self.bits):
            out &= (self.data[p >> 3] >> (p & 7) & 1).astype(bool)
        return out

    @classmethod
    def of(cls, column: DataFrame, bits: int = 25) -> Bloom:
        """Of a frame with one column of longs. The filter's size is fixed, so it may be sent to every worker."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            data = np.zeros(1 << bits - 3, np.uint8)
            for batch in it:
                for p in cls._probes(batch.column(0).to_numpy(), bits):
                    np.bitwise_or.at(data, p >> 3, (1 << (p & 7)).astype(np.uint8))
            full = [k for k, x in enumerate(data.reshape(SLICES, -1)) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([data.reshape(SLICES, -1)[k].tobytes() for k in full], pa.binary())], ["slice", "data"])

        size = (1 << bits - 3) // SLICES
        parts = column.mapInArrow(run, "slice int, data binary").repartition(SLICES, "slice")

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for batch in it:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held[k] = _either(held[k], [data]) if k in held else [data]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.binary())], ["slice", "data"])

        data = np.zeros(1 << bits - 3, np.uint8)
        for r in parts.mapInArrow(place, "slice int, data binary").collect():
            data[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["data"], np.uint8)
        return cls(data, bits)
