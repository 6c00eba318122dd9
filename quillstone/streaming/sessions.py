"""Streaming form of conversation leakage: one small state for each conversation, whatever its length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.functions import patterns as P

OUTPUT = "conv_id long, turn long, turn_number long, " + ", ".join(f"cum_{a} double" for a in P.ATTRIBUTES) + ", overall double, capacity double, delta double, breached boolean, band string"
#: Idle time after which a conversation ends.
IDLE_MS = 3_600_000
STATE = "turns long, overall double, " + ", ".join(f"left_{a} double, top_{a} double" for a in P.ATTRIBUTES)


def _round(x: float) -> float:
    return float(int(x * 1e4 + 0.5 + 1e-9)) / 1e4 if x >= 0 else -_round(-x)


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, expires: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turns, overall, *rest = state.get if state.exists else (0, 0.0, *([1.0, 0.0] * len(P.ATTRIBUTES)))
    left, top = list(rest[0::2]), list(rest[1::2])
    out = []
    for row in pd.concat(list(frames)).sort_values("turn").itertuples(index=False):
        turns += 1
        cumulative = []
        for i, a in enumerate(P.ATTRIBUTES):
            p = float(getattr(row, a))
            if p > P.NOISE_FLOOR:
                left[i] *= 1 - p
            top[i] = max(top[i], p)
            joint = 1 - left[i]
            cumulative.append(_round(min(1.0, max(0.0, joint if joint else top[i]))))
        now, capacity = max(cumulative), _round(sum(max(0.0, 1 - c) for c in cumulative))
        band = "HIGH" if now >= P.HIGH_EDGE else "MEDIUM" if now >= P.MEDIUM_EDGE else "LOW"
        out.append((key[0], row.turn, turns, *cumulative, now, capacity, _round(now - overall), now >= P.HIGH_EDGE or capacity < P.CAPACITY_FLOOR, band))
        overall = now
    state.update((turns, overall, *(x for pair in zip(left, top, strict=True) for x in pair)))
    if expires:
        state.setTimeoutDuration(IDLE_MS)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def leakage_stream(scores: DataFrame, expires: bool = False) -> DataFrame:
    """Streaming (conv_id, turn, a column for each attribute) to one leakage row for each turn, in the order of turns
    within a micro-batch. With expires, an hour without a turn ends a conversation's state."""

    def advance(key, frames, state):
        yield from _advance(key, frames, state, expires)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout
    return scores.groupBy("conv_id").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)
