"""Conversation leakage: risk that adds up over the turns of a conversation, as windows over (conversation, turn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions.privacy import band
from quillstone.functions.text import let


def cumulative_risk(scores: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """scores (by, order, one column for each attribute) with turn_number, cum_<attribute>, overall, capacity, delta,
    breached and band. A score at or below the noise floor is no evidence: 1 - product(1 - score) runs over the others;
    with no evidence so far the largest noise counts. One shuffle, on the conversation."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = Window.partitionBy(by).orderBy(order)
    cumulative = {}
    for a in P.ATTRIBUTES:
        evidence = F.when(F.col(a) > P.NOISE_FLOOR, F.col(a)).otherwise(0.0)
        joint = 1 - F.product(1 - evidence).over(upto)
        value = F.when(joint == 0.0, F.max(a).over(upto)).otherwise(joint)
        cumulative[f"cum_{a}"] = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)
    out = scores.withColumns(cumulative | {"turn_number": F.row_number().over(ordered)})
    cols = [F.col(f"cum_{a}") for a in P.ATTRIBUTES]
    capacity = sum((F.greatest(F.lit(0.0), 1.0 - c) for c in cols), F.lit(0.0))
    out = out.withColumns({"overall": F.greatest(*cols), "capacity": F.round(capacity, 4)})
    delta = F.round(F.col("overall") - F.coalesce(F.lag("overall").over(ordered), F.lit(0.0)), 4)
    return out.withColumns({"delta": delta, "breached": (F.col("overall") >= P.HIGH_EDGE) | (F.col("capacity") < P.CAPACITY_FLOOR), "band": band(F.col("overall"))})


def inferability(probabilities: Column) -> Column:
    """How much a distribution gives away: excess of the top over chance, times half (1 - normalised entropy) and half the
    margin of the top two."""
    k = F.size(probabilities)
    ranked = F.sort_array(probabilities, asc=False)
    top, second = ranked[0], F.when(k > 1, ranked[1]).otherwise(0.0)
    chance = 1.0 / k
    excess = F.when(chance < 1, F.greatest(F.lit(0.0), (top - chance) / (1 - chance))).otherwise(0.0)
    entropy = -F.aggregate(probabilities, F.lit(0.0), lambda s, p: s + p * F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))))
    normal = F.when(k > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), entropy / F.log(k.cast("double"))))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), excess * (0.5 * (1 - normal) + 0.5 * (top - second))))


def ui_scale(raw: Column, medium: float = P.MEDIUM_EDGE, high: float = P.HIGH_EDGE) -> Column:
    """Piecewise linear map of a raw score onto the scale whose band edges are .30 and .60."""
    value = (
        F.when(raw < medium, 0.30 * (raw / max(medium, 1e-6)))
        .when(raw < high, 0.30 + 0.30 * ((raw - medium) / max(high - medium, 1e-6)))
        .otherwise(0.60 + 0.40 * ((raw - high) / max(1 - high, 1e-6)))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)


def turn_distributions(labels: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, order, attribute, label, p, weight) from guessed labels, one column for each attribute: a known guess gets .60
    and the rest share .40 with weight .60; without one the distribution is uniform and has no weight."""
    parts = []
    for a, names in P.TAXONOMY.items():
        k = len(names)
        label = F.explode(F.array(*map(F.lit, names)))
        known = F.col(a).isin(*names)
        part = labels.select(by, order, F.lit(a).alias("attribute"), F.col(a).alias("guess"), known.alias("known"), label.alias("label"))
        p = F.when(~F.col("known"), 1.0 / k).when(F.col("guess") == F.col("label"), 0.60).otherwise(0.40 / (k - 1))
        parts.append(part.select(by, order, "attribute", "label", F.lit(k).alias("k"), p.alias("p"), F.when(F.col("known"), 0.60).otherwise(0.0).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def posterior_leakage(distributions: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """(by, order, one score for each attribute, leakage, delta). Evidence adds up in log space, weight * ln(k p) for each
    label; the softmax of the running sums is the posterior. Leakage is the root mean square of the two largest attribute
    scores, and never falls."""
    run = Window.partitionBy(by, "attribute", "label").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    p = F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(1e-9))
    logs = distributions.withColumn("log", F.sum(F.col("weight") * F.log(p * F.col("k"))).over(run))
    parts = logs.groupBy(by, order, "attribute").agg(F.max("log").alias("top"), F.collect_list("log").alias("logs"))
    shares = F.transform("logs", lambda x: F.exp(x - F.col("top")))
    parts = parts.withColumn("e", shares).withColumn("post", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, v: s + v)))
    wide = parts.groupBy(by, order).pivot("attribute", list(P.ATTRIBUTES)).agg(F.first(ui_scale(inferability(F.col("post")))))
    top = F.slice(F.sort_array(F.array(*P.ATTRIBUTES), asc=False), 1, 2)
    now = F.round(F.sqrt((top[0] * top[0] + top[1] * top[1]) / 2), 4)
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = wide.withColumn("leakage", F.max(now).over(upto))
    return out.withColumn("delta", F.round(F.col("leakage") - F.coalesce(F.lag("leakage").over(Window.partitionBy(by).orderBy(order)), F.lit(0.0)), 4))


def _softmax(logs: Column) -> Column:
    grown = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return let(grown, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x)))


def label_leakage(labels: DataFrame, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """posterior_leakage of turn_distributions, straight from the guessed labels (one column for each attribute): the running
    sum of every label is a column of one window, so there is one scan, one shuffle and no row for each label."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = {}
    for a, names in P.TAXONOMY.items():
        k = len(names)
        known = F.col(a).isin(*names)
        for i, name in enumerate(names):
            share = F.when(F.col(a) == name, 0.60).otherwise(0.40 / (k - 1))
            sums[f"__{a}{i}"] = F.sum(F.when(known, 0.60 * F.log(share * k)).otherwise(0.0)).over(upto)
    wide = labels.select(by, order, *(c.alias(n) for n, c in sums.items()))
    logs = {a: F.array(*(F.col(f"__{a}{i}") for i in range(len(names)))) for a, names in P.TAXONOMY.items()}
    wide = wide.select(by, order, *(let(x, _softmax).alias(f"__{a}") for a, x in logs.items()))
    wide = wide.select(by, order, *(let(F.col(f"__{a}"), lambda v: ui_scale(inferability(v))).alias(a) for a in P.ATTRIBUTES))
    top = F.slice(F.sort_array(F.array(*P.ATTRIBUTES), asc=False), 1, 2)
    now = F.round(F.sqrt((top[0] * top[0] + top[1] * top[1]) / 2), 4)
    out = wide.withColumn("leakage", F.max(now).over(upto))
    return out.withColumn("delta", F.round(F.col("leakage") - F.coalesce(F.lag("leakage").over(Window.partitionBy(by).orderBy(order)), F.lit(0.0)), 4))


def prefix_curve(turns: DataFrame, counts=(1, 2, 4, 8), by: str = "conv_id", number: str = "turn_number", value: str = "overall") -> DataFrame:
    """(by, requested, used, value): a running value after so many turns, or after the last if there are fewer."""
    length = turns.groupBy(by).agg(F.max(number).alias("turns"))
    asked = length.select(by, "turns", F.explode(F.array(*map(F.lit, counts))).alias("requested"))
    asked = asked.withColumn("used", F.least("requested", "turns"))
    return asked.join(turns.select(by, F.col(number).alias("used"), value), [by, "used"]).select(by, "requested", "used", value)
