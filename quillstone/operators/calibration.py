"""Calibration: bin tables over equal widths or equal counts, band checks, and parameters fitted to binary logits.

Everything begins with counts of equal scores, so what follows works on as many rows as there are different scores.
Quantile edges are exact order statistics, found by running counts over ranges of the scores. Parameters are fitted by
Newton steps: each step is one aggregate that sums gradient and curvature of all groups, and a group rests once its step
is small. Groups are heads of a model; the driver holds a row of parameters for each of them.

Defined cases: null scores and labels do not count; scores outside 0 to 1 and labels other than 0 and 1 are an error; a
group without rows is not in the result; a bin without rows has its middle as confidence and 0 as accuracy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators.running import running
from quillstone.sources.tables import written

#: Least step between edges; gaps that still count as calibrated, of a band and of all.
STEP, BAND_GAP, WHOLE_GAP = 1e-6, 0.08, 0.05


def _counts(scored: DataFrame, by: str, p: str, y: str) -> DataFrame:
    """(by, p, n, pos), checked."""
    ok = F.when(F.col(p).between(0.0, 1.0) & F.col(y).isin(0, 1), F.col(p)).otherwise(F.raise_error(F.lit("scores must lie in [0, 1] and labels be 0 or 1")).cast("double"))
    rows = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(F.col(by).alias("by"), ok.alias("p"), F.col(y).cast("long").alias("y"))
    return rows.groupBy("by", "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


def _lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation that gives a for t = 0 and b for t = 1."""
    return F.when(t < 0.5, a + (b - a) * t).otherwise(b - (b - a) * (1 - t))


def edges(counts: DataFrame, bins: int, strategy: str = "uniform") -> DataFrame:
    """(by, edges array<double>) of bins + 1 rising edges from 0: of equal widths, or at the quantiles of the scores (linear
    between order statistics); edges that would not rise stand STEP above the one before."""
    if strategy == "uniform":
        return counts.groupBy("by").agg(F.count("*")).select("by", F.array(*(F.lit(k / bins) for k in range(bins + 1))).alias("edges"))
    whole = counts.groupBy(F.col("by").alias("__by")).agg(F.sum("n").alias("all"))
    placed = running(counts, ["by"], [F.col("p")], {"upto": F.col("n")}).join(whole, F.col("by").eqNullSafe(F.col("__by")))
    # Each score says for which edges it is the order statistic below or above.
    at = lambda k: k * (F.col("all") - 1) / F.lit(float(bins))
    here = lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto"))
    each = placed.select("by", "p", "n", "upto", "all", F.explode(F.sequence(F.lit(1), F.lit(bins - 1)) if bins > 1 else F.array().cast("array<int>")).alias("k")).withColumn("at", at(F.col("k")))
    each = each.select("by", "k", F.col("at") - F.floor("at"), F.when(here(F.floor("at")), F.col("p")), F.when(here(F.ceil("at")), F.col("p"))).toDF("by", "k", "t", "low", "high").where("low IS NOT NULL OR high IS NOT NULL")
    inner = each.groupBy("by", "k").agg(_lerp(F.max("low"), F.max("high"), F.max("t")).alias("e"))
    inner = inner.groupBy("by").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("inner"))  # bins - 1 numbers a group
    raw = F.concat(F.coalesce("inner", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    rise = lambda s, e: F.concat(s, F.array(F.when(e <= F.element_at(s, -1), F.element_at(s, -1) + STEP).otherwise(e)))
    groups = whole.join(inner, F.col("__by").eqNullSafe(F.col("by")), "left")
    return groups.select(F.col("__by").alias("by"), F.aggregate(raw, F.array(F.lit(0.0)), rise).alias("edges"))


def _gap() -> Column:
    return F.abs(F.col("accuracy") - F.col("confidence"))


def table(scored: DataFrame, bins: int = 10, strategy: str = "uniform", by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """(by, bin, low, high, n, confidence, accuracy) of every bin, also of empty ones. Bins are open below and closed above;
    the first holds 0, too."""
    counts = _counts(scored, by, p, y)
    counts = written(counts) if strategy != "uniform" else counts
    of = edges(counts, bins, strategy).withColumnRenamed("by", "__by")
    placed = counts.join(of, F.col("by").eqNullSafe(F.col("__by"))).withColumn("bin", F.size(F.filter(F.slice("edges", 2, bins - 1), lambda e: e < F.col("p"))) if bins > 1 else F.lit(0))
    found = placed.groupBy(F.col("by").alias("__g"), F.col("bin").alias("__b")).agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("confidence"), (F.sum("pos") / F.sum("n")).alias("accuracy"))
    dense = of.select("__by", F.col("edges"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select("__by", "bin", F.get("edges", F.col("bin")).alias("low"), F.get("edges", F.col("bin") + 1).alias("high"))
    out = dense.join(found, F.col("__by").eqNullSafe(F.col("__g")) & (F.col("bin") == F.col("__b")), "left")
    return out.select(F.col("__by").alias(by), "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", (F.col("low") + F.col("high")) / 2).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def summary(bin_table: DataFrame, by: str = "attribute") -> DataFrame:
    """(by, ece, mce, calibrated) of a bin table."""
    full = F.when(F.col("n") > 0, _gap())
    out = bin_table.groupBy(by).agg((F.sum(full * F.col("n")) / F.sum("n")).alias("ece"), F.max(full).alias("mce"))
    return out.withColumn("calibrated", F.col("ece") < WHOLE_GAP)


def band_checks(scored: DataFrame, by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """(by, band, low, high, n, confidence, accuracy, gap, well): the three risk bands, each closed below and open above, the
    last one closed. An empty band has no gap and is well calibrated."""
    spans = (("LOW", 0.0, P.MEDIUM_EDGE), ("MEDIUM", P.MEDIUM_EDGE, P.HIGH_EDGE), ("HIGH", P.HIGH_EDGE, 1.0))
    counts = _counts(scored, by, p, y)
    band = F.when(F.col("p") >= P.HIGH_EDGE, "HIGH").when(F.col("p") >= P.MEDIUM_EDGE, "MEDIUM").otherwise("LOW")
    found = counts.groupBy(F.col("by").alias("__g"), band.alias("__b")).agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("confidence"), (F.sum("pos") / F.sum("n")).alias("accuracy"))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(low).alias("low"), F.lit(high).alias("high")) for b, low, high in spans)))
    dense = counts.groupBy("by").agg(F.count("*")).select("by", each.alias("s")).select("by", "s.*")
    out = dense.join(found, F.col("by").eqNullSafe(F.col("__g")) & (F.col("band") == F.col("__b")), "left")
    out = out.select(F.col("by").alias(by), "band", "low", "high", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("confidence", (F.col("low") + F.col("high")) / 2).alias("confidence"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))
    out = out.withColumn("gap", F.when(F.col("n") > 0, _gap()).otherwise(0.0))
    return out.withColumn("well", F.col("gap") < BAND_GAP)


# -- parameters of binary logits -----------------------------------------------------------------------------------

PARAMETERS = "head string, method string, temperature double, slope double, shift double, ece_before double, ece_after double, steps int"
#: The ridge of the two-parameter fit, the slope's least value, and when a fit ends.
RIDGE, LEAST_SLOPE, STEPS, SMALL = 0.01, 1e-4, 60, 1e-9


def _sums(cells: DataFrame, params: dict[str, tuple[float, float]]) -> dict[str, list[float]]:
    """Means of the gradient and the curvature of the log-loss of sigmoid(a z + b), in one aggregate over all heads."""
    at = F.create_map(*(x for h, (a, b) in params.items() for x in (F.lit(h), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
    x = F.element_at(at, F.col("head"))
    q = 1 / (1 + F.exp(-(x["a"] * F.col("z") + x["b"])))
    rows = cells.where(F.col("head").isin(*params)).select("head", "z", "n", "pos", q.alias("q"))
    off, bend = F.col("q") * F.col("n") - F.col("pos"), F.col("q") * (1 - F.col("q")) * F.col("n")
    z = F.col("z")
    terms = [off * z, off, bend * z * z, bend * z, bend]
    out = rows.groupBy("head").agg(*((F.sum(t) / F.sum("n")).alias(f"s{i}") for i, t in enumerate(terms)), (F.sum(F.col("pos") * -F.ln(F.greatest(F.col("q"), F.lit(1e-300))) - (F.col("n") - F.col("pos")) * F.ln(F.greatest(1 - F.col("q"), F.lit(1e-300)))) / F.sum("n")).alias("loss"))
    return {r["head"]: [r[f"s{i}"] for i in range(5)] + [r["loss"]] for r in out.collect()}  # a row for each head


def _newton(cells: DataFrame, heads: list[str], both: bool) -> dict[str, tuple[float, float, int]]:
    """(slope, shift, steps) of each head: of the least log-loss in the slope alone, or in both with a ridge towards (1, 0). A
    step that does not lower the loss is halved; the slope stays positive."""
    ridge = RIDGE if both else 0.0
    now = {h: (1.0, 0.0) for h in heads}
    done: dict[str, tuple[float, float, int]] = {}
    cost = lambda s, a, b: s[5] + ridge * ((a - 1) ** 2 + b * b)
    sums = _sums(cells, now)
    step: dict[str, tuple[float, float]] = {}
    for k in range(STEPS):
        trial = {}
        for h in [h for h in now if h not in done]:
            a, b = now[h]
            g, gb, haa, hab, hbb, _ = sums[h]
            if h not in step:
                g, gb, haa, hbb = g + 2 * ridge * (a - 1), gb + 2 * ridge * b, haa + 2 * ridge + 1e-12, hbb + 2 * ridge
                if both and not (a <= LEAST_SLOPE and g > 0):
                    det = haa * hbb - hab * hab
                    step[h] = ((hbb * g - hab * gb) / det, (haa * gb - hab * g) / det)
                else:
                    step[h] = (0.0, gb / hbb) if both else (g / haa, 0.0)
            trial[h] = (max(LEAST_SLOPE, a - step[h][0]), b - step[h][1])
        if not trial:
            break
        found = _sums(cells, trial)
        for h, (a, b) in trial.items():
            if abs(a - now[h][0]) + abs(b - now[h][1]) < SMALL:
                done[h] = (*now[h], k + 1)
            elif math.isfinite(found[h][5]) and cost(found[h], a, b) <= cost(sums[h], *now[h]):
                now[h], sums[h] = (a, b), found[h]
                del step[h]
            else:
                step[h] = (step[h][0] / 2, step[h][1] / 2)
    return {h: done.get(h, (*now[h], STEPS)) for h in heads}


def fitted(rows: DataFrame, by: str = "attribute", logit: str = "logit", y: str = "y", threshold: float = WHOLE_GAP, bins: int = 10) -> DataFrame:
    """PARAMETERS of each head, from binary logits: a temperature; where the calibration error stays at or above the
    threshold, a slope and a shift, kept only if they make it smaller."""
    spark = rows.sparkSession
    cells = rows.where(F.col(logit).isNotNull() & F.col(y).isin(0, 1)).groupBy(F.col(by).cast("string").alias("head"), F.col(logit).cast("double").alias("z")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))
    cells = written(cells.where("head IS NOT NULL"))
    heads = [r["head"] for r in cells.select("head").distinct().orderBy("head").collect()]
    if not heads:
        return spark.createDataFrame([], PARAMETERS)

    def ece(params: dict[str, tuple[float, float]]) -> dict[str, float]:
        at = F.create_map(*(x for h, (a, b) in params.items() for x in (F.lit(h), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))))
        x = F.element_at(at, F.col("head"))
        q = cells.where(F.col("head").isin(*params)).select("head", "n", "pos", (1 / (1 + F.exp(-(x["a"] * F.col("z") + x["b"])))).alias("q"))
        bin_of = F.greatest(F.lit(1), F.ceil(F.col("q") * bins))
        per = q.groupBy("head", bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("q") * F.col("n")).alias("q"))
        return {r["head"]: r["e"] for r in per.groupBy("head").agg((F.sum(F.abs(F.col("pos") - F.col("q"))) / F.sum("n")).alias("e")).collect()}

    before = ece({h: (1.0, 0.0) for h in heads})
    scaled = _newton(cells, heads, both=False)
    after = ece({h: s[:2] for h, s in scaled.items()})
    out = {h: (h, "temperature", 1 / a, a, b, before[h], after[h], k) for h, (a, b, k) in scaled.items()}
    if poor := [h for h in heads if after[h] >= threshold]:
        moved = _newton(cells, poor, both=True)
        better = ece({h: s[:2] for h, s in moved.items()})
        for h, (a, b, k) in moved.items():
            if better[h] < after[h]:
                out[h] = (h, "platt", out[h][2], a, b, before[h], better[h], k)
    return spark.createDataFrame([out[h] for h in heads], PARAMETERS)


def calibrated(rows: DataFrame, params: DataFrame, by: str = "attribute", logit: str = "logit") -> DataFrame:
    """rows with probability; a head without parameters keeps its logit."""
    p = params.select(F.col("head").alias("__h"), F.col("slope").alias("__a"), F.col("shift").alias("__b"))
    z = F.coalesce("__a", F.lit(1.0)) * F.col(logit) + F.coalesce("__b", F.lit(0.0))
    return rows.join(p, F.col(by).cast("string") == F.col("__h"), "left").withColumn("probability", 1 / (1 + F.exp(-z))).drop("__h", "__a", "__b")


def save(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETERS).json(path)
