"""Cues, highlights, benchmark scores, training rows, answers and samples: smaller operators over texts and spans."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators.cues import CUE
from quillstone.operators.spans import without_overlaps

# Words and scores of the keyword variant of the risk score.
KEYWORD_SCORES = {
    "age": (0.75, ("born", "age", "old", "graduated", "years old")),
    "location": (0.85, ("living", "city", "boston", "seattle", "chicago")),
    "occupation": (0.80, ("doctor", "engineer", "nurse", "teacher", "surgeon", "work")),
    "education": (0.70, ("degree", "mit", "university", "college", "phd", "graduated")),
}
KEYWORD_QUIET = 0.1
# Capital words that are no names.
ACRONYMS = ("ED", "ER", "ICU", "OR", "IT", "HR", "PR", "AI", "ML", "RN", "MD")
# What is stripped from a model's answer.
THINKING, THINK_TAGS, ANSWER_LABEL = r"<think>[\s\S]*?</think>", r"</?think>", r"^(?:rewritten(?: comment| text)?|rewrite|output)\s*:\s*"
NO_ANSWER = ("unknown", "none", "n/a", "na", "null")


def keyword_scores(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    hit = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return {a: F.when(hit(words), score).otherwise(KEYWORD_QUIET) for a, (score, words) in KEYWORD_SCORES.items()}


def escaped(text: Column) -> Column:
    for plain, by in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(by))
    return text


def highlighted(text: Column, cues: Column) -> Column:
    """HTML of the text with its cues marked: of cues that meet the more important, then the longer, stands; places are cut to
    the text. Null text is empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    cut = F.transform(F.coalesce(cues, F.expr(f"cast(array() as array<{CUE}>)")), lambda c: F.struct(c["attribute"].alias("attribute"), F.greatest(c["start"], F.lit(0)).alias("start"), F.least(c["end"], n).alias("end"), c["importance"].alias("importance")))
    kept = without_overlaps(F.filter(cut, lambda c: c["start"] < c["end"]), lambda c: F.struct((-c["importance"]).alias("i"), (c["start"] - c["end"]).alias("l")))
    piece = lambda a, b: escaped(F.substring(text, a + 1, b - a))

    def step(s: Column, c: Column) -> Column:
        mark = F.concat(
            F.lit('<mark class="cue cue-'), c["attribute"], F.lit('" data-attribute="'), c["attribute"], F.lit('" data-importance="'), F.format_string("%.2f", c["importance"]),
            F.lit('">'), piece(c["start"], c["end"]), F.lit('<span class="cue-badge">'), c["attribute"], F.lit("</span></mark>"),
        )
        return F.struct(F.concat(s["html"], piece(s["at"], c["start"]), mark).alias("html"), c["end"].alias("at"))

    return F.aggregate(kept, F.struct(F.lit("").alias("html"), F.lit(0).alias("at")), step, lambda s: F.concat(s["html"], piece(s["at"], n)))


def without_acronyms(names: Column) -> Column:
    """The surfaces that are no well-known capital abbreviation."""
    return F.filter(names, lambda s: ~F.upper(F.trim(s)).isin(*ACRONYMS))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text as a whole, in any case."""
    return F.rlike(text, F.concat(F.lit(r"(?iU)(?<![\w])\Q"), F.replace(phrase, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![\w])")))


def benchmark_scores(rows: DataFrame, original: str = "text", rewrite: str = "rewrite", pii: str = "pii", invariants: str = "invariants") -> DataFrame:
    """rows with leaked, removal_rate, missing, invariant_rate, copied and passed: which annotated surfaces are still there,
    which required ones went, and whether the text came back as it was. A rate over nothing is null."""
    new = F.col(rewrite)
    out = rows.withColumns({"leaked": F.filter(pii, lambda s: contains_phrase(new, s)), "missing": F.filter(invariants, lambda s: ~contains_phrase(new, s))})
    share = lambda part, whole: F.when(F.size(whole) > 0, F.round(1 - F.size(part) / F.size(whole), 4))
    out = out.withColumns({"removal_rate": share("leaked", pii), "invariant_rate": share("missing", invariants), "copied": (F.size(pii) > 0) & (F.trim(new) == F.trim(original))})
    return out.withColumn("passed", (F.size("leaked") == 0) & (F.size("missing") == 0) & ~F.col("copied"))


def benchmark_summary(scored: DataFrame, by: str) -> DataFrame:
    return scored.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg("removal_rate"), 4).alias("mean_removal_rate"),
        F.round(F.avg("invariant_rate"), 4).alias("mean_invariant_rate"), F.count_if("copied").alias("copied"), F.sum(F.size("leaked")).alias("leaked"),
    )


def annotated(text: Column, surfaces: tuple[str, ...]) -> Column:
    """The surfaces that stand in the text, in the given order."""
    return F.filter(F.array(*map(F.lit, surfaces)), lambda s: contains_phrase(text, s))


def edit_ratio(a: Column, b: Column) -> Column:
    """One minus the matching-blocks ratio of the two token lists; 0 for two texts without tokens."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1 - difflib.SequenceMatcher(None, list(p), list(q)).ratio() for p, q in zip(x, y, strict=True)])

    empty = F.expr("cast(array() as array<string>)")
    return ratio(F.coalesce(T.tokens(a), empty), F.coalesce(T.tokens(b), empty))


def cleaned_answer(text: Column) -> Column:
    """A model's answer without its thinking, its label and the quotes around it."""
    out = F.trim(F.regexp_replace(F.regexp_replace(text, THINKING, ""), THINK_TAGS, ""))
    out = F.regexp_replace(out, f"(?i){ANSWER_LABEL}", "")
    for first, last in (('"', '"'), ("'", "'"), ("“", "”")):
        out = F.when((F.length(out) >= 2) & out.startswith(first) & out.endswith(last), F.trim(F.substring(out, F.lit(2), F.length(out) - 2))).otherwise(out)
    return F.trim(out)


def answer_values(answer: Column) -> Column:
    """map of lower-cased key -> value of the first JSON object in an answer (all between the outer braces, else any pair of
    braces); without one, what stands behind the names of the attributes."""
    parse = lambda x: F.from_json(x, "map<string,string>")
    whole = F.regexp_extract(answer, r"\{[\s\S]*\}", 0)
    each = F.regexp_extract_all(answer, F.lit(r"\{[^{}]*\}"), F.lit(0))
    parsed = F.get(F.filter(F.transform(F.concat(F.array(whole), each), parse), lambda m: m.isNotNull() & (F.size(m) > 0) & ~F.map_contains_key(m, "_corrupt_record")), F.lit(0))
    keyed = F.transform_keys(parsed, lambda k, _: F.lower(F.trim(k)))
    behind = lambda a: F.trim(F.regexp_extract(answer, rf"""(?i)["']?{a}["']?\s*[:=]\s*["']?([^"'\n,}}]+)""", 1))
    scraped = F.map_filter(F.create_map(*(x for a in P.ATTRIBUTES for x in (F.lit(a), behind(a)))), lambda _, v: v != "")
    return F.coalesce(keyed, scraped)


def answer_label(attribute: str, values: Column) -> Column:
    """Label of an attribute in an answer's values: a label that is or stands in the value, else the value's own class."""
    raw = F.trim(F.coalesce(F.element_at(values, attribute), F.lit("")))
    low = F.lower(raw)
    named = F.get(F.filter(F.array(*map(F.lit, P.TAXONOMY[attribute])), lambda x: F.contains(low, F.lower(x))), F.lit(0))
    return F.when((low == "") | low.isin(*NO_ANSWER), "UNKNOWN").otherwise(F.coalesce(named, V.taxonomy_label(attribute, raw)))


def chat_row(original: Column, rewrite: Column, system: str) -> Column:
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    answer = F.trim(F.regexp_replace(rewrite, THINKING, ""))
    return F.array(said("system", F.lit(system)), said("user", original), said("assistant", answer))


def instruction_row(original: Column, rewrite: Column, instruction: str) -> Column:
    return F.struct(F.lit(instruction).alias("instruction"), original.alias("input"), F.trim(F.regexp_replace(rewrite, THINKING, "")).alias("output"))


def cue_instruction(scores: dict[str, Column], cues: Column, text: Column, most: int = 6) -> Column:
    """A control text: attributes of at least medium risk with their bands, the first cues, and the message."""
    risky = F.array_compact(F.array(*(F.when(s >= P.MEDIUM_EDGE, F.format_string("%s (%s: %.2f)", F.lit(a), V.band(s), s)) for a, s in scores.items())))
    shown = F.transform(F.slice(cues, 1, most), lambda c: F.format_string('"%s" -> %s (importance=%.2f)', c["surface"], c["attribute"], c["importance"]))
    some = lambda x, sep, none: F.when(F.size(x) > 0, F.array_join(x, sep)).otherwise(none)
    return F.concat(F.lit("[RISK_ATTRIBUTES]: "), some(risky, ", ", "None (LOW RISK)"), F.lit("\n[DETECTED_CUES]: "), some(shown, "; ", "None detected"), F.lit("\n[MESSAGE]: "), text)


def numbered_turns(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(": "), t)), "\n")


def weighted_sample(rows: DataFrame, key: str, item: Column, weight: Column, k: int, seed: int) -> DataFrame:
    """(key, item) of k items for each key, drawn without replacement with the weights: those with the greatest ln(u)/w, where
    u comes from a hash of key, item and seed."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), item, F.lit(str(seed)))), 1, 8), 16, 10).cast("double")
    drawn = rows.select(key, item.alias("item"), (F.ln((digest + 1) / 4294967297.0) / weight).alias("o"))
    best = drawn.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("o")).alias("o"), "item"))), 1, k).alias("best"))  # a few items a key
    return best.select(key, F.explode("best.item").alias("item"))


def safest(rows: DataFrame, candidates: str, attempts: int = 3) -> DataFrame:
    """rows with the safest of the first candidates: no identifier left before any, then the least risk, then the first."""
    order = lambda c, i: F.struct(V.scrubbed(c)[1].cast("int").alias("leak"), F.greatest(*V.rule_scores(c).values()).alias("risk"), i.alias("attempt"), c.alias("text"))
    return rows.withColumn("safest", F.array_min(F.transform(F.slice(candidates, 1, attempts), order)))


def anchors(raw: Column) -> Column:
    """Parts of a list written with commas or semicolons, without brackets and blanks; null for nothing."""
    bare = F.regexp_replace(raw, r"^[()\s]+|[()\s]+$", "")
    return F.when(F.coalesce(raw, F.lit("")) != "", F.filter(F.transform(F.split(bare, "[;,]"), lambda x: F.trim(x)), lambda x: x != ""))


def usefulness(raw: Column, default: float = 5.0) -> Column:
    """A score in words: a number, the mean of a range such as 3-5, else the default."""
    parts = F.transform(F.filter(F.split(raw, "-"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    of_range = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(parts) > 0, F.size(parts))
    return F.coalesce(F.when(F.contains(raw, F.lit("-")), of_range).otherwise(F.trim(raw).try_cast("double")), F.lit(default))


def iso_date(raw: Column) -> Column:
    """m/d/y as y-mm-dd; other texts as they are."""
    m = r"^(\d+)/(\d+)/(\d+)$"
    part = lambda k: F.regexp_extract(raw, m, k)
    return F.when(raw.rlike(m), F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).otherwise(raw)


def paired(fn: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A seam for a model of text pairs, such as an embedder's similarity: a function of two texts as a column function."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(fn(x or "", y or "")) for x, y in zip(a, b, strict=True)])

    return run


def rewriter(make: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A seam for a rewriting model, made once in a worker."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = make()
        for texts in batches:
            yield texts.map(lambda t: rewrite(t or ""))

    return run


def generated(rows: DataFrame, text: str, generate: Callable[[list[str]], list[str]], batch: int = 64) -> DataFrame:
    """rows with generated: a batch that runs out of memory is halved until it fits; one text that does not raises."""

    def halving(texts: list[str]) -> list[str]:
        try:
            return generate(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return halving(texts[:half]) + halving(texts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = f[text].fillna("").tolist()
            yield f.assign(generated=[x for i in range(0, len(texts), batch) for x in halving(texts[i : i + batch])])

    return rows.mapInPandas(run, f"{', '.join(f'`{x.name}` {x.dataType.simpleString()}' for x in rows.schema)}, generated string")


def fitted_temperatures(rows: DataFrame, by: str = "attribute", logits: str = "logits", label: str = "label") -> DataFrame:
    """(by, temperature, nll_before, nll_after, n): the temperature of 0.05 to 10 with the least negative log-likelihood. Every
    temperature of a logarithmic grid is tried in one distributed aggregate, then a finer grid around the best one; no group
    is gathered in a task. Labels below zero or null do not count."""
    rows = rows.where((F.col(label) >= 0) & F.col(logits).isNotNull()).select(by, F.col(logits).alias("z"), F.col(label).alias("y"))

    def losses(grid: list[float], source: DataFrame, temperature) -> DataFrame:
        loss = lambda t: F.ln(F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("z")) / t))) + (F.array_max("z") - F.element_at("z", F.col("y").cast("int") + 1)) / t
        terms = [F.avg(loss(temperature(g))).alias(f"l{i}") for i, g in enumerate(grid)]
        return source.groupBy(by).agg(F.count("*").alias("n"), F.avg(loss(F.lit(1.0))).alias("nll_before"), *terms)

    def least(found: DataFrame, grid: list[float], temperature) -> DataFrame:
        best = F.array_min(F.array(*(F.struct(F.col(f"l{i}").alias("l"), temperature(g).alias("t")) for i, g in enumerate(grid))))
        return found.withColumn("best", best)

    coarse = list(np.geomspace(0.05, 10.0, 25).tolist())
    first = least(losses(coarse, rows, F.lit), coarse, F.lit).select(by, F.col("best")["t"].alias("t0"))
    step = (10.0 / 0.05) ** (1 / 24)
    fine = np.geomspace(1 / step, step, 41).tolist()
    at = lambda g: F.least(F.greatest(F.col("t0") * g, F.lit(0.05)), F.lit(10.0))
    second = losses(fine, rows.join(first, by), lambda g: at(g))
    out = least(second.join(first, by), fine, at)
    return out.select(by, F.round(F.col("best")["t"], 4).alias("temperature"), F.round("nll_before", 4).alias("nll_before"), F.round(F.col("best")["l"], 4).alias("nll_after"), "n")
