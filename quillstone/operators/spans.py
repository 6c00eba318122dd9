"""Spans with offsets, found by patterns in Arrow batches, and the operations on arrays of spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P

#: What the tokens of each kind of entity begin with.
SESSION_PREFIX = {"EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "ORGANIZATION": "ORG", "LOCATION": "LOCATION", "PERSON": "PERSON"}
SPAN = "struct<type:string,start:int,end:int,surface:string,confidence:double>"


def explicit_spans(text: Column, rules: dict[str, str] | None = None, ignore_case: bool = False, confidence: float = 0.95, ascii_words: bool = False) -> Column:
    """array of spans of the patterns, by start. A pattern with a group gives the group's place. Null text: no span. With
    ascii_words an accented letter is no part of a word."""
    compiled = {k: re.compile(p, re.IGNORECASE * ignore_case | re.ASCII * ascii_words) for k, p in (rules or P.EXPLICIT).items()}

    @F.pandas_udf(f"array<{SPAN}>")
    def find(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            spans = [(k, *m.span(1 if p.groups else 0)) for k, p in compiled.items() for m in p.finditer(t or "")]
            spans.sort(key=lambda s: (s[1], s[2]))
            out.append([{"type": k, "start": a, "end": b, "surface": t[a:b], "confidence": confidence} for k, a, b in spans])
        return pd.Series(out)

    return find(text)


def without_overlaps(spans: Column, order) -> Column:
    """Greedy choice: spans in the order (a function of a span that gives the sort key) are taken unless they meet one
    that is taken. The result is by start."""
    ranked = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(order(s).alias("o"), s.alias("s")))), lambda x: x["s"])
    empty = F.filter(spans, lambda s: F.lit(False))
    meets = lambda acc, s: F.exists(acc, lambda k: (F.greatest(k["start"], s["start"]) < F.least(k["end"], s["end"])))
    kept = F.aggregate(ranked, empty, lambda acc, s: F.when(meets(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("o"), s.alias("s")))), lambda x: x["s"])


def longest_first(s: Column) -> Column:
    return F.struct((s["start"] - s["end"]).alias("l"), s["start"].alias("a"))


def surest_first(s: Column) -> Column:
    return F.struct((-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), s["start"].alias("a"))


def spliced(text: Column, replacements: Column) -> Column:
    """The text with array<struct<start,end,token>> put in, from right to left so that offsets hold."""
    order = F.reverse(F.array_sort(replacements))
    return F.aggregate(order, text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["token"], F.substring(t, r["end"] + 1, F.length(t))))


def pseudonymised(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(by, order, pseudonymised, tokens): entities as TYPE_n, numbered in a conversation by first appearance; the same
    entity keeps its token. Spans are chosen by confidence, then length."""
    prefix = F.create_map(*(F.lit(x) for kv in SESSION_PREFIX.items() for x in kv))
    found = messages.select(by, order, F.col(text).alias("t"), without_overlaps(explicit_spans(F.col(text), P.SESSION_ENTITIES, ignore_case=True), surest_first).alias("spans"))
    each = found.select(by, order, F.explode("spans").alias("s")).select(by, order, "s.*", F.regexp_replace(F.lower(F.trim("s.surface")), r"\s+", " ").alias("name"))
    from pyspark.sql import Window

    first = each.groupBy(by, "type", "name").agg(F.min(F.struct(F.col(order), F.col("start"))).alias("at"))
    n = F.row_number().over(Window.partitionBy(by, "type").orderBy("at"))
    tokens = first.select(by, "type", "name", F.concat(F.element_at(prefix, F.col("type")), F.lit("_"), n).alias("token"))
    puts = each.join(tokens, [by, "type", "name"]).groupBy(by, order).agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("puts"))
    out = found.join(puts, [by, order], "left")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,token:string>>)")
    puts = F.coalesce("puts", empty)
    return out.select(by, order, spliced(F.col("t"), puts).alias("pseudonymised"), F.array_join(F.array_distinct(F.transform(puts, lambda p: p["token"])), ",").alias("tokens"))
