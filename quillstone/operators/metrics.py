"""Evaluation metrics as aggregates: classification, ranking, calibration and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions.text import let
from quillstone.operators.running import running


def rate(condition: Column) -> Column:
    """Share of rows, rounded to four places; null without rows."""
    return F.round(F.sum(condition.cast("int")) / F.count("*"), 4)


def pr_auc(scored: DataFrame, by: str = "attribute", p: str = "p", y: str = "y", tie: str = "id") -> DataFrame:
    """Step-wise average precision. Rows of equal score are taken in the order of `tie`. Counts run over ranges of the
    order, so a group with very many rows is not one task."""
    rows = running(scored.select(by, p, y, tie), [by], [F.desc(p), F.col(tie)], {"tp": F.col(y), "k": F.lit(1)})
    return rows.groupBy(by).agg(F.coalesce(F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("k"))) / F.sum(y), F.lit(0.0)).alias("pr_auc"))


def roc_auc(scored: DataFrame, by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """Mann-Whitney statistic with average ranks; .5 if a class is missing. Ranks run over distinct scores only, in ranges."""
    values = scored.groupBy(by, p).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    ranked = running(values, [by], [F.col(p)], {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.groupBy(by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("a"), (F.sum("n") - F.sum("pos")).alias("b"))
    auc = (F.col("r") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b"))
    return s.select(by, F.when((F.col("a") == 0) | (F.col("b") == 0), 0.5).otherwise(auc).alias("roc_auc"))


def at_threshold(scored: DataFrame, threshold: float = 0.5, by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """F1, balanced accuracy (a missing class counts .5), precision, recall and the weight of the positive class."""
    hit = F.col(p) >= threshold
    n = lambda c: F.sum(c.cast("int"))
    tp, fp, fn, tn = n(hit & (F.col(y) == 1)), n(hit & (F.col(y) == 0)), n(~hit & (F.col(y) == 1)), n(~hit & (F.col(y) == 0))
    ratio = lambda a, b, other: F.when(b > 0, a / b).otherwise(other)
    return scored.groupBy(by).agg(
        ratio(2.0 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        (0.5 * (ratio(tp, tp + fn, 0.5) + ratio(tn, tn + fp, 0.5))).alias("balanced_accuracy"),
        ratio(tp, tp + fp, 0.0).alias("precision"),
        ratio(tp, tp + fn, 0.0).alias("recall"),
        ((fp + tn) / F.greatest(tp + fn, F.lit(1))).alias("pos_weight"),
    )


def calibration(scored: DataFrame, bins: int = 10, edges: str = "upper", by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """(by, ece, mce, brier). edges: `upper` puts a score on an edge into the lower bin (the first bin also has 0),
    `lower` into the upper one (the last also has 1)."""
    x = F.col(p) * bins
    b = F.greatest(F.lit(1), F.ceil(x)) if edges == "upper" else F.least(F.floor(x), F.lit(bins - 1))
    per = scored.groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(y).alias("accuracy"), F.sum((F.col(p) - F.col(y)) ** 2).alias("square"))
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return per.groupBy(by).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("square") / F.sum("n")).alias("brier"))


def threshold_curve(scored: DataFrame, by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """(by, t, precision, recall) at every distinct score (to six places), 0 and 1, for the rule score >= t."""
    values = scored.groupBy(by, F.round(p, 6).alias("t")).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    ends = scored.select(by).distinct().select(by, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"))
    all_t = values.unionByName(ends).groupBy(by, "t").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    whole = all_t.groupBy(F.col(by).alias("__by")).agg(F.sum("pos").alias("all_pos"))  # a row for each group
    rows = running(all_t, [by], [F.desc("t")], {"called": F.col("n"), "tp": F.col("pos")}).join(whole, F.col(by).eqNullSafe(F.col("__by")))
    precision = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    recall = F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).otherwise(0.0)
    return rows.select(by, "t", precision.alias("precision"), recall.alias("recall"))


def fitted_thresholds(scored: DataFrame, high_precision: float = 0.60, low_recall: float = 0.90, width: float = 0.05, by: str = "attribute") -> DataFrame:
    """(by, medium_edge, high_edge, degraded): the lowest threshold that reaches the precision (else the most precise one,
    degraded), and the highest up to which recall holds without a break; edges stay `width` apart."""
    curve = threshold_curve(scored, by)
    # Recall falls as the threshold rises: it holds up to the last threshold below the first at which it does not.
    broken = curve.groupBy(F.col(by).alias("__by")).agg(F.min(F.when(F.col("recall") < low_recall, F.col("t"))).alias("__broken"))
    curve = curve.join(broken, F.col(by).eqNullSafe(F.col("__by")))
    edges = curve.groupBy(by).agg(
        F.min(F.when(F.col("precision") >= high_precision, F.col("t"))).alias("reached"),
        F.max_by("t", F.struct("precision", -F.col("t"))).alias("best"),
        F.coalesce(F.max(F.when(F.col("__broken").isNull() | (F.col("t") < F.col("__broken")), F.col("t"))), F.lit(0.0)).alias("low"),
    )
    high = F.coalesce("reached", "best")
    medium = F.when(high - F.col("low") < width, F.greatest(F.lit(0.0), high - width)).otherwise(F.col("low"))
    return edges.select(by, F.round(medium, 4).alias("medium_edge"), F.round(high, 4).alias("high_edge"), (F.col("reached").isNull() | (F.col("low") == 0.0)).alias("degraded"))


def youden_thresholds(scored: DataFrame, by: str = "attribute", p: str = "p", y: str = "y") -> DataFrame:
    """(by, high, medium): on the 91 steps from .05 to .95, the first with the best true minus false positive rate and the
    first whose true positive rate is nearest to .85. Scores are counted by step first, so the grid meets 92 numbers."""
    step = F.greatest(F.lit(0), F.least(F.lit(91), F.floor((F.col(p) - 0.05) * 100 + 1e-9) + 1)).cast("int")  # grid steps at or below
    counts = scored.groupBy(by, step.alias("steps")).agg(F.sum(y).alias("pos"), (F.count("*") - F.sum(y)).alias("neg"))
    grid = scored.select(by).distinct().select(by, F.explode(F.sequence(F.lit(1), F.lit(91))).alias("steps"))
    full = grid.join(counts.where("steps > 0"), [by, "steps"], "left").na.fill(0, ["pos", "neg"])
    totals = counts.groupBy(by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    down = Window.partitionBy(by).orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, 0)
    rows = full.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down)}).join(totals, by)
    rows = rows.select(by, "steps", F.round(F.col("tp") / F.col("all_pos"), 12).alias("tpr"), F.round(F.col("fp") / F.col("all_neg"), 12).alias("fpr"))
    value = lambda s: F.round(0.04 + s * 0.01, 2)
    best = rows.groupBy(by).agg(
        F.min_by("steps", F.struct(F.round(F.col("fpr") - F.col("tpr"), 12), F.col("steps"))).alias("h"), F.min_by("steps", F.struct(F.round(F.abs(F.col("tpr") - 0.85), 12), F.col("steps"))).alias("m")
    )
    return best.select(by, value(F.col("h")).alias("high"), value(F.col("m")).alias("medium"))


def attack_metrics(guesses: DataFrame, truth: str = "label", guess: str = "guess", label=None) -> DataFrame:
    """(method, attribute, accuracy, abstained, macro_f1, n). Truths outside the label list are left out; every label of
    the list counts in the mean, with 0 where it never occurs. label (attribute and truth as columns to a column) turns
    free-text truths into labels: equal ones are counted first, so that it runs once for each of them and not for each row."""
    listed = F.array(*(F.lit(f"{a}:{x}") for a, labels in P.TAXONOMY.items() for x in labels))
    cells = guesses.groupBy("method", "attribute", F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    if label is not None:
        # As a function of an array's element: long cascades of keywords stay out of the generated code.
        cells = cells.select("method", "attribute", let(F.col("t"), lambda t: label(F.col("attribute"), t)).alias("t"), "g", "n")
        cells = cells.groupBy("method", "attribute", "t", "g").agg(F.sum("n").alias("n"))
    cells = cells.where(F.array_contains(listed, F.concat_ws(":", "attribute", "t")))
    # One confusion table for each method and attribute, of as many cells as there are labels and guesses.
    table = cells.groupBy("method", "attribute").agg(F.collect_list(F.struct("t", "g", "n")).alias("c"))
    total = lambda test: F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    labels = F.element_at(F.create_map(*(z for a, names in P.TAXONOMY.items() for z in (F.lit(a), F.array(*map(F.lit, names))))), F.col("attribute"))
    f1 = lambda x: F.struct(total(lambda c: (c["t"] == x) & (c["g"] == x)).alias("tp"), (total(lambda c: c["t"] == x) + total(lambda c: c["g"] == x)).alias("all"))
    macro = F.aggregate(F.transform(labels, f1), F.lit(0.0), lambda s, x: s + F.when(x["all"] > 0, 2.0 * x["tp"] / x["all"]).otherwise(0.0)) / F.size(labels)
    table = table.withColumn("n", total(lambda c: F.lit(True)))
    return table.select("method", "attribute", (total(lambda c: c["t"] == c["g"]) / F.col("n")).alias("accuracy"), (total(lambda c: c["g"] == "UNKNOWN") / F.col("n")).alias("abstained"), macro.alias("macro_f1"), "n")


def multiclass_ece(rows: DataFrame, confidence: str = "confidence", hit: str = "hit", bins: int = 15) -> DataFrame:
    """One number: bins open below and closed above, so a confidence of 0 falls out of the sum but not of the total."""
    per = rows.groupBy(F.ceil(F.col(confidence) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(hit).alias("a"))
    return per.agg((F.sum(F.when(F.col("bin") > 0, F.abs(F.col("c") - F.col("a")) * F.col("n")).otherwise(0.0)) / F.sum("n")).alias("ece"))
