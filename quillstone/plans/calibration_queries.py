"""Bin tables, band checks and fitted calibration, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators import calibration as C
from quillstone.plans.inputs import SCORED, scored

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _table(edges: str) -> str:
    return f"""{SCORED}, ed AS ({edges}), b AS (SELECT attribute, e, unnest(range(10)) AS bin FROM ed),
    d AS (SELECT attribute, bin, e[bin + 1] AS low, e[bin + 2] AS high FROM b), s AS (SELECT scored.attribute, p, y, len(list_filter(e[2:10], lambda x: x < p)) AS bin FROM scored JOIN ed USING (attribute)),
    g AS (SELECT attribute, bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM s GROUP BY ALL),
    t AS (SELECT d.attribute, d.bin, low, high, coalesce(n, 0) AS n, coalesce(c, (low + high) / 2) AS confidence, coalesce(a, 0.0) AS accuracy FROM d LEFT JOIN g USING (attribute, bin))"""


_EVEN = "SELECT attribute, list_transform(range(11), lambda k: k / 10.0::DOUBLE) AS e FROM scored GROUP BY attribute"
_QUANTILE = "SELECT attribute, [0.0::DOUBLE] || quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) || [1.0::DOUBLE] AS e FROM scored GROUP BY attribute"
_SHOWN = "SELECT attribute, CAST(bin AS INTEGER) AS bin, round(low, 6) AS low, round(high, 6) AS high, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM t"


def _shown(t: DataFrame) -> DataFrame:
    return t.select("attribute", F.col("bin").cast("int").alias("bin"), *(F.round(c, 6).alias(c) for c in ("low", "high")), "n", *(F.round(c, 6).alias(c) for c in ("confidence", "accuracy")))


@query("agg25_bin_table", f"WITH {_table(_EVEN)} {_SHOWN}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(C.table(scored(spark, sf), 10))


@query("agg25_quantile_table", f"WITH {_table(_QUANTILE)} {_SHOWN}")
def _(spark, sf):
    return _shown(C.table(scored(spark, sf), 10, "quantile"))


@query("agg25_quantile_calibration", f"WITH {_table(_QUANTILE)} SELECT attribute, round(sum(abs(accuracy - confidence) * n) / sum(n), 6) AS ece, round(max(CASE WHEN n > 0 THEN abs(accuracy - confidence) END), 6) AS mce, sum(abs(accuracy - confidence) * n) / sum(n) < 0.05 AS calibrated FROM t GROUP BY attribute")
def _(spark, sf):
    return C.summary(C.table(scored(spark, sf), 10, "quantile")).select("attribute", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"), "calibrated")


_BANDS = "SELECT unnest([{'b': 'LOW', 'l': 0.0::DOUBLE, 'h': 0.30::DOUBLE}, {'b': 'MEDIUM', 'l': 0.30::DOUBLE, 'h': 0.60::DOUBLE}, {'b': 'HIGH', 'l': 0.60::DOUBLE, 'h': 1.0::DOUBLE}], recursive := true)"


@query("agg25_band_checks", f"""WITH {SCORED}, bd AS ({_BANDS}), g AS (SELECT attribute, CASE WHEN p >= 0.60 THEN 'HIGH' WHEN p >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM scored GROUP BY ALL),
    t AS (SELECT a.attribute, bd.b AS band, l AS low, h AS high, coalesce(n, 0) AS n, coalesce(c, (l + h) / 2) AS confidence, coalesce(g.a, 0.0) AS accuracy FROM (SELECT DISTINCT attribute FROM scored) a, bd LEFT JOIN g ON g.attribute = a.attribute AND g.b = bd.b)
    SELECT attribute, band, low, high, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(CASE WHEN n > 0 THEN abs(accuracy - confidence) ELSE 0.0 END, 6) AS gap, n = 0 OR abs(accuracy - confidence) < 0.08 AS well FROM t""")
def _(spark, sf):
    return C.band_checks(scored(spark, sf)).select("attribute", "band", "low", "high", "n", *(F.round(c, 6).alias(c) for c in ("confidence", "accuracy", "gap")), "well")


def logits(spark, sf) -> DataFrame:
    """(attribute, logit, y): the scores as logits that are too sharp and, for some attributes, shifted."""
    p = F.greatest(F.least(F.col("p"), F.lit(0.999)), F.lit(0.001))
    shift = F.element_at(F.create_map(*(x for a, s in zip(P.ATTRIBUTES, (0.0, 1.5, -2.0, 0.2), strict=True) for x in (F.lit(a), F.lit(s)))), F.col("attribute"))
    return scored(spark, sf).select("id", "attribute", (2.5 * F.ln(p / (1 - p)) + shift).alias("logit"), "y")


@query("udf09_fitted_scaling")
def _(spark, sf):
    """Temperature, or slope and shift where a temperature does not do, for the logits of each attribute."""
    out = C.fitted(logits(spark, sf))
    return out.select("head", "method", *(F.round(c, 4).alias(c) for c in ("temperature", "slope", "shift", "ece_before", "ece_after")))


@query("aux07_saved_scaling")
def _(spark, sf):
    """Mean calibrated probability and share of positives by attribute, with parameters that were saved and read again."""
    from quillstone.sources.tables import shared_folder

    rows, path = logits(spark, sf), shared_folder(spark)
    C.save(C.fitted(rows), path)
    out = C.calibrated(rows, C.load(spark, path))
    return out.groupBy("attribute").agg(F.round(F.avg("probability"), 4).alias("probability"), F.round(F.avg("y"), 4).alias("positives"), F.count("*").alias("n"))
