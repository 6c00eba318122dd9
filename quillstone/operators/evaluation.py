"""Attack success over variants of a text: by hardness, by attribute, and as a table to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.contracts import errors

HARDNESS = ("direct", "indirect", "complicated")


def hits(rows: DataFrame, keys: list[str], variants: dict[str, str], truth: dict[str, Column], attack) -> DataFrame:
    """(keys, attribute, variant, hit) for each attribute whose truth is known: whether an attacker (a text to a guess for
    each attribute) finds it in the variant, a column of rows. UNKNOWN truths and guesses are no hits."""
    each = [
        F.struct(F.lit(a).alias("attribute"), F.lit(v).alias("variant"), truth[a].alias("truth"), guess.alias("guess"))
        for v, text in variants.items()
        for a, guess in attack(F.col(text)).items()
    ]
    out = rows.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*").where("truth IS NOT NULL AND truth <> 'UNKNOWN'")
    return out.select(*keys, "attribute", "variant", F.coalesce(F.col("guess") == F.col("truth"), F.lit(False)).alias("hit"))


def by_hardness(found: DataFrame, variants: list[str], hardness: str = "hardness") -> DataFrame:
    """(hardness, variant, n, asr, reduction): success rates in each stratum, dense; without rows n is 0 and the rates are
    null. The reduction is against the first variant in the stratum."""
    rates = found.groupBy(hardness, "variant").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    wide = rates.groupBy(hardness).agg(*(F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{i}") for i, v in enumerate(variants) for c in ("n", "k")))
    dense = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, HARDNESS))).alias("__h"))
    wide = dense.join(wide, F.col("__h") == F.col(hardness), "left")
    rate = lambda i: F.when(F.col(f"n_{i}") > 0, F.col(f"k_{i}") / F.col(f"n_{i}"))
    rows = F.array(*(F.struct(F.lit(v).alias("variant"), F.coalesce(f"n_{i}", F.lit(0)).alias("n"), F.round(rate(i), 4).alias("asr"), F.round(rate(0) - rate(i), 4).alias("reduction")) for i, v in enumerate(variants)))
    return wide.select(F.col("__h").alias(hardness), F.inline(rows))


def deltas(found: DataFrame, raw: str, baseline: str, student: str) -> DataFrame:
    """(attribute, n, raw, baseline, student, delta): success rates by attribute and over all, and what the student takes off
    the baseline's."""
    rate = lambda v: F.avg(F.when(F.col("variant") == v, F.col("hit").cast("double")))
    out = found.rollup("attribute").agg(F.count_if(F.col("variant") == raw).alias("n"), rate(raw).alias("raw"), rate(baseline).alias("baseline"), rate(student).alias("student"))
    return out.select(F.coalesce("attribute", F.lit("all")).alias("attribute"), "n", *(F.round(c, 4).alias(c) for c in ("raw", "baseline", "student")), F.round(F.col("baseline") - F.col("student"), 4).alias("delta"))


def matrix(table: DataFrame, columns: list[str]) -> DataFrame:
    """(line, markdown) of a small table: a head, a rule, and a line for each row in the order of the columns. A null is a
    dash, and bars in a text are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("–")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    lines = table.select(F.struct(*columns).alias("o"), row.alias("markdown")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "markdown"))), lambda x: x["markdown"]).alias("rows"))  # few rows
    whole = F.concat(F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("|" + "-|" * len(columns))), "rows")
    return lines.select(F.posexplode(whole).alias("line", "markdown"))


def gate(record: Column, blocking, diagnosing) -> Column:
    """struct<status,reasons> of a VARIANT report: BLOCKED if a blocking rule is broken, DIAGNOSTIC_ONLY if only a diagnosing
    one is, else PASS."""
    hard, soft = errors(record, blocking), F.when(record.isNull(), F.array().cast("array<string>")).otherwise(errors(record, diagnosing))
    status = F.when(F.size(hard) > 0, "BLOCKED").when(F.size(soft) > 0, "DIAGNOSTIC_ONLY").otherwise("PASS")
    return F.struct(status.alias("status"), F.concat(hard, soft).alias("reasons"))

