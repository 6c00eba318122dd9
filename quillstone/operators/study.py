"""Summaries of user-study records: one row of metrics for all records, or one for each group. Counts and rates take only
the records that carry a field; a rate over none is null; means, medians and rates are rounded to four places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision words by kind, comprehension labels, and codes with a meaning of their own.
ACCEPT = ("accept", "use_as_is", "would_use", "accept_as_is")
EDIT = ("accept_with_edits", "use_with_edits", "would_use_with_edits")
REJECT = ("reject", "would_not_use")
NOT_APPLICABLE = ("not_applicable",)
COMPREHENSION = ("correct", "echo", "incorrect", "partial")
PASSTHROUGH_STATE = "risk_negative_passthrough"
TRUST_FAILURE = "F08"


def rate(count: Column, total: Column) -> Column:
    return F.round(count / F.when(total != 0, total), 4)


def mean(x: Column) -> Column:
    return F.round(F.avg(x), 4)


def median(x: Column) -> Column:
    return F.round(F.median(x), 4)


def grouped(records: DataFrame, metrics: dict[str, Column], by: str | None = None) -> DataFrame:
    return (records.groupBy(by) if by else records.groupBy()).agg(*(c.alias(k) for k, c in metrics.items()))


def decisions(decision: str = "decision") -> dict[str, Column]:
    d = F.col(decision)
    n = lambda words: F.count_if(d.isin(*words))
    accept, edit, reject, none = n(ACCEPT), n(EDIT), n(REJECT), n(NOT_APPLICABLE)
    observed = F.count(d)
    total = observed - none
    return {
        "total": total, "observed": observed, "accept": accept, "accept_with_edits": edit, "reject": reject, "not_applicable": none, "other": total - accept - edit - reject,
        "acceptance_rate": rate(accept + edit, total), "as_is_rate": rate(accept, total), "edit_rate": rate(edit, total), "rejection_rate": rate(reject, total),
    }


def comprehension(records: DataFrame, label: str = "comprehension", legacy: str = "understood") -> DataFrame:
    """(kind, label, n, rate): every comprehension label with its count, also of none. Where no record has such a label, the
    older yes or no counts, and without that either there is no row. The counts are one small aggregate."""
    found = records.groupBy().agg(
        *(F.count_if(F.col(label) == c).alias(f"c_{c}") for c in COMPREHENSION), F.count(legacy).alias("n_legacy"), F.count_if(F.col(legacy)).alias("yes")
    )
    labels = F.array(*(F.struct(F.lit("categorical").alias("kind"), F.lit(c).alias("label"), F.col(f"c_{c}").alias("n")) for c in COMPREHENSION))
    old = F.array(*(F.struct(F.lit("boolean").alias("kind"), F.lit(k).alias("label"), n.alias("n")) for k, n in (("correct", F.col("yes")), ("incorrect", F.col("n_legacy") - F.col("yes")))))
    some = F.when(F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + x["n"]) > 0, labels).when(F.col("n_legacy") > 0, old)
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = found.select(some.alias("rows")).select(total.alias("total"), F.explode_outer("rows").alias("r")).where("r IS NOT NULL")
    return rows.select("r.kind", "r.label", "r.n", rate(F.col("r")["n"], F.col("total")).alias("rate"))


def detection(detected: str = "detected", score: str = "risk_score") -> dict[str, Column]:
    n, yes = F.count(detected), F.count_if(F.col(detected))
    return {"evaluated": n, "detected": yes, "detected_rate": rate(yes, n), "score_mean": mean(F.col(score)), "score_median": median(F.col(score))}


def adoption(would_use: str = "would_use") -> dict[str, Column]:
    n, yes = F.count(would_use), F.count_if(F.col(would_use))
    return {"adoption_evaluated": n, "would_use": yes, "would_not_use": n - yes, "adoption_rate": rate(yes, n)}


def usefulness(score: str = "usefulness") -> dict[str, Column]:
    return {"usefulness_n": F.count(score), "usefulness_mean": mean(F.col(score)), "usefulness_median": median(F.col(score))}


def latency(fields: tuple[str, ...] = ("latency_s", "latency", "client_latency"), query: str = "query_seconds", decision: str = "decision_seconds") -> dict[str, Column]:
    """The first of the latency fields that any record at all has is the one that counts."""
    first = lambda f: F.coalesce(*(f(F.col(c)) for c in fields))
    return {
        "latency_mean": first(mean), "latency_median": first(median), "query_mean": mean(F.col(query)), "query_median": median(F.col(query)),
        "decision_mean": mean(F.col(decision)), "decision_median": median(F.col(decision)),
    }


def protocol(deviation: str = "deviation", intervention: str = "intervention") -> dict[str, Column]:
    n, d, i = F.count("*"), F.count_if(F.col(deviation)), F.count_if(F.col(intervention))
    return {"records": n, "deviations": d, "deviation_rate": rate(d, n), "interventions": i, "intervention_rate": rate(i, n)}


def failures(modes: str = "failure_modes") -> dict[str, Column]:
    n, some = F.count("*"), F.count_if(F.size(modes) > 0)
    trust = F.sum(F.size(F.filter(F.coalesce(modes, F.expr("cast(array() as array<string>)")), lambda x: x == TRUST_FAILURE)))
    return {"with_failure": some, "failure_rate": rate(some, n), "trust_failures": trust, "trust_failure_rate": rate(trust, n)}


def label_counts(records: DataFrame, label: Column, share: bool = False) -> DataFrame:
    """(label, n) and, with share, the rate among the labelled records; null labels do not count."""
    n = records.select(label.alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    if not share:
        return n
    return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("label", "n", rate(F.col("n"), F.col("total")).alias("rate"))  # one row beside a few


def privacy(before: str = "risk_before", after: str = "risk_after", delta: str = "risk_delta") -> dict[str, Column]:
    """Deltas given with the records go before those of pairs; a paired delta below zero is an inversion."""
    paired = F.col(before) - F.col(after)
    inverted = F.count_if(paired < 0)
    return {
        "before_mean": mean(F.col(before)), "after_mean": mean(F.col(after)), "delta_mean": F.coalesce(mean(F.col(delta)), mean(paired)),
        "delta_median": F.coalesce(median(F.col(delta)), median(paired)), "inversions": inverted, "inversion_rate": rate(inverted, F.count(paired)),
    }


def utility(fields: tuple[str, ...]) -> dict[str, Column]:
    return {f"{f}_{k}": c(F.col(f)) for f in fields for k, c in (("mean", mean), ("median", median))}


def multiturn(records: DataFrame, turn: str = "turn_risk", cumulative: str = "cumulative_risk", turns: str = "turns") -> DataFrame:
    """Means and maxima over the fields of the records and of their turns, and how many records have any of them."""
    pair = lambda t, c: F.struct(t.cast("double").alias("t"), c.cast("double").alias("c"))
    inner = F.transform(F.coalesce(turns, F.expr("cast(array() as array<struct<turn_risk:double,cumulative_risk:double>>)")), lambda x: pair(x[turn], x[cumulative]))
    every = F.filter(F.concat(F.array(pair(F.col(turn), F.col(cumulative))), inner), lambda x: x["t"].isNotNull() | x["c"].isNotNull())
    per = records.select(every.alias("v")).where(F.size("v") > 0)
    fold = lambda k, f: F.aggregate(F.transform("v", lambda x: x[k]), F.lit(None).cast("double"), lambda s, x: f(s, x))
    total = lambda k: fold(k, lambda s, x: F.when(x.isNull(), s).otherwise(F.coalesce(s, F.lit(0.0)) + x))
    most = lambda k: fold(k, lambda s, x: F.greatest(s, x))
    size = lambda k: F.size(F.filter("v", lambda x: x[k].isNotNull()))
    per = per.select(*(c.alias(f"{n}_{k}") for k in ("t", "c") for n, c in (("s", total(k)), ("m", most(k)), ("n", size(k)))))
    out = {"records": F.count("*")}
    for k, name in (("t", "turn"), ("c", "cumulative")):
        out[f"{name}_mean"] = F.round(F.sum(f"s_{k}") / F.sum(f"n_{k}"), 4)
        out[f"{name}_max"] = F.round(F.max(f"m_{k}"), 4)
    return per.groupBy().agg(*(c.alias(k) for k, c in out.items()))


def as_metrics(row: DataFrame) -> DataFrame:
    """(metric, value as text) of the columns of a summary, for a CSV of metrics; nulls are empty."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("p")).select("p.metric", "p.value")
