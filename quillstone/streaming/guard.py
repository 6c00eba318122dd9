"""Guarded conversations as a stream: entity tokens, beliefs about the author and leakage in one keyed state.

Each turn is met twice: once as it was written, to say what it would give away (peek), and once as it is served, which is
what the conversation remembers (commit). Both are computed in one step and the state is written once.

Turns may come late. They wait in the conversation's state until the watermark has passed their time and are then taken in
the order of their times, so that the result does not depend on how turns were dealt to micro-batches; turns later than
the watermark allows are dropped by Spark (it begins with 1970, so that times up to then are always late). A conversation that stays idle for longer than `idle_ms` of event time is
forgotten with its tokens and beliefs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.functions import patterns as P
from quillstone.operators.spans import SESSION_PREFIX, explicit_spans, surest_first, without_overlaps

OUTPUT = (
    "conv_id long, turn long, turn_number long, tokens string, entities long, "
    + ", ".join(f"{a} double" for a in P.ATTRIBUTES)
    + ", leakage_before double, delta_before double, leakage double, delta double"
)
_PENDING = "at long, turn long, kinds string, names string, before string, after string"
_BELIEF = "logs array<double>, leakage double, turns long, entities long, last long"
#: Separates entities and labels in the state's strings.
_CUT = "\x1f"
KNOWN, REST = 0.60, 0.40


def prepared(turns: DataFrame, text: str, served: dict[str, Column], written: dict[str, Column]) -> DataFrame:
    """(conv_id, turn, ts, kinds, names, before, after) of turns (conv_id, turn, ts, text): the entities of the text in the
    order of their places, and the labels guessed from the text as written and as served."""
    spans = without_overlaps(explicit_spans(F.col(text), P.SESSION_ENTITIES, ignore_case=True, ascii_words=True), surest_first)
    names = F.transform("spans", lambda s: F.regexp_replace(F.lower(F.trim(s["surface"])), r"\s+", " "))
    labels = [F.concat_ws(_CUT, *(labels[a] for a in P.ATTRIBUTES)).alias(n) for n, labels in (("before", written), ("after", served))]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "ts", spans.alias("spans"), *labels)
    return rows.select("conv_id", "turn", "ts", F.concat_ws(_CUT, F.transform("spans", lambda s: s["type"])).alias("kinds"), F.concat_ws(_CUT, names).alias("names"), "before", "after")


def evidence(labels: str) -> np.ndarray:
    """Weighted log-likelihood ratios of all labels of all attributes: a guess adds up, its absence says nothing."""
    out = []
    for a, guess in zip(P.ATTRIBUTES, labels.split(_CUT), strict=True):
        names = P.TAXONOMY[a]
        k = len(names)
        share = np.full(k, REST / (k - 1))
        if guess in names:
            share[names.index(guess)] = KNOWN
            out.append(KNOWN * np.log(share * k))
        else:
            out.append(np.zeros(k))
    return np.concatenate(out)


def _scores(logs: np.ndarray) -> list[float]:
    """Each attribute's inferability on the scale of the bands."""
    out, at = [], 0
    for a in P.ATTRIBUTES:
        k = len(P.TAXONOMY[a])
        p = np.exp(logs[at : at + k] - logs[at : at + k].max())
        p /= p.sum()
        at += k
        second, top = np.sort(p)[-2:]
        normal = min(1.0, max(0.0, float(-(p * np.log(np.maximum(p, 1e-12))).sum() / np.log(k))))
        raw = min(1.0, max(0.0, (top - 1 / k) / (1 - 1 / k) * (0.5 * (1 - normal) + 0.5 * (top - second))))
        low, high = P.MEDIUM_EDGE, P.HIGH_EDGE
        scaled = 0.30 * raw / low if raw < low else 0.30 + 0.30 * (raw - low) / (high - low) if raw < high else 0.60 + 0.40 * (raw - high) / (1 - high)
        out.append(round(float(min(1.0, max(0.0, scaled))), 4))
    return out


def _leak(scores: list[float]) -> float:
    one, two = sorted(scores)[-2:]
    return round(float(np.sqrt((one * one + two * two) / 2)), 4)


class _Guard(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PENDING)
        self.tokens = handle.getMapState("tokens", "kind string, name string", "token string")
        self.numbers = handle.getMapState("numbers", "prefix string", "n long")
        self.belief = handle.getValueState("belief", _BELIEF)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Turns are only put by: their time's timer takes them in order."""
        for frame in rows:
            values = [(int(t.value // 1_000_000), int(n), *rest) for t, n, *rest in frame[["ts", "turn", "kinds", "names", "before", "after"]].itertuples(index=False, name=None)]
            self.pending.appendList(values)
            for at in {v[0] for v in values}:
                self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.pending.get(), key=lambda v: (v[0], v[1])) if self.pending.exists() else []
        due = [v for v in waiting if v[0] <= now]
        if due:
            if rest := waiting[len(due) :]:
                self.pending.put(rest)
            else:
                self.pending.clear()
            yield self._advanced(int(key[0]), due)
            self.handle.registerTimer(due[-1][0] + self.idle_ms + 1)
        elif not waiting and self.belief.exists() and now > self.belief.get()[4] + self.idle_ms:
            for state in (self.tokens, self.numbers, self.belief):
                state.clear()

    def _advanced(self, conv: int, due: list[tuple]) -> pd.DataFrame:
        logs, leakage, turns, entities, last = self.belief.get() if self.belief.exists() else ([0.0] * sum(map(len, P.TAXONOMY.values())), 0.0, 0, 0, 0)
        logs, out = np.array(logs, float), []
        for at, turn, kinds, names, before, after in due:
            if turns and at > last + self.idle_ms:  # the gap ended the conversation before this turn
                for state in (self.tokens, self.numbers):
                    state.clear()
                logs, leakage, turns, entities = np.zeros(len(logs)), 0.0, 0, 0
            tokens = []
            for kind, name in zip(kinds.split(_CUT), names.split(_CUT), strict=True) if kinds else ():
                if not self.tokens.containsKey((kind, name)):
                    prefix = SESSION_PREFIX[kind]
                    n = self.numbers.getValue((prefix,))[0] + 1 if self.numbers.containsKey((prefix,)) else 1
                    self.numbers.updateValue((prefix,), (n,))
                    self.tokens.updateValue((kind, name), (f"{prefix}_{n}",))
                    entities += 1
                tokens.append(self.tokens.getValue((kind, name))[0])
            peeked = max(leakage, _leak(_scores(logs + evidence(before))))
            logs = logs + evidence(after)
            scores = _scores(logs)
            now = max(leakage, _leak(scores))
            turns += 1
            out.append((conv, turn, turns, ",".join(dict.fromkeys(tokens)), entities, *scores, peeked, round(peeked - leakage, 4), now, round(now - leakage, 4)))
            leakage, last = now, at
        self.belief.update((logs.tolist(), leakage, turns, entities, last))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def guarded(turns: DataFrame, lateness: str = "5 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """Streaming rows of `prepared` to one row a turn (OUTPUT), as the watermark passes them. Needs the RocksDB state store
    (`keyed_state`)."""
    return turns.withWatermark("ts", lateness).groupBy("conv_id").transformWithStateInPandas(_Guard(idle_ms), OUTPUT, "append", "eventtime")


def keyed_state(spark: SparkSession) -> None:
    """State of several variables for a key is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
