"""Seams for models: each takes a maker, which runs once in a worker's task, and gives a column function.

A model gets batches of texts, never nulls (a null text is empty). What it gives back is checked, so that a wrong model
fails where it is plugged in and not later: as many results as texts, scores from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.operators.cues import CUE


def _batches(make: Callable, series: Iterator[pd.Series]) -> Iterator[tuple[list[str], list]]:
    model = make()
    for texts in series:
        texts = texts.fillna("").tolist()
        found = list(model(texts))
        if len(found) != len(texts):
            raise ValueError(f"the model gave {len(found)} results for {len(texts)} texts")
        yield texts, found


def risk_model(make: Callable[[], Callable[[list[str]], Sequence[dict[str, float]]]]) -> Callable[[Column], Column]:
    """texts to map<attribute,score>."""

    @F.pandas_udf("map<string,double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, found in _batches(make, series):
            if any(not 0.0 <= s <= 1.0 for scores in found for s in scores.values()):
                raise ValueError("a score is outside 0 to 1")
            yield pd.Series([{a: float(s) for a, s in scores.items()} for scores in found])

    return run


def candidate_model(make: Callable[[], Callable[[list[str]], Sequence[list[str]]]]) -> Callable[[Column], Column]:
    """texts to array<candidate>: distinct ones in order, without empty ones."""

    @F.pandas_udf("array<string>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, found in _batches(make, series):
            yield pd.Series([list(dict.fromkeys(c for c in candidates if c and c.strip())) for candidates in found])

    return run


def value_scanner(make: Callable[[], Callable[[list[str]], Sequence[list[str]]]]) -> Callable[[Column, Column], Column]:
    """(before, after) to array<surface>: what the scanner finds in the text after and the text before does not hold."""

    @F.pandas_udf("array<string>")
    def scan(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for _, found in _batches(make, series):
            yield pd.Series([list(dict.fromkeys(surfaces)) for surfaces in found])

    def new(before: Column, after: Column) -> Column:
        return F.filter(scan(after), lambda s: ~F.contains(F.coalesce(before, F.lit("")), s))

    return new


def attributor(make: Callable[[], Callable[[list[str]], Sequence[list[tuple[str, int, int, float]]]]]) -> Callable[[Column], Column]:
    """texts to array of cues, from (attribute, start, end, importance); places outside the text are an error."""

    @F.pandas_udf(f"array<{CUE}>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts, found in _batches(make, series):
            if any(not 0 <= a < b <= len(t) for t, cues in zip(texts, found, strict=True) for _, a, b, _ in cues):
                raise ValueError("a cue is outside its text")
            yield pd.Series([[{"attribute": k, "start": a, "end": b, "surface": t[a:b], "importance": float(w)} for k, a, b, w in cues] for t, cues in zip(texts, found, strict=True)])

    return run
