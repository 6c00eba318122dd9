"""Queries over scores, guesses, spans and study records; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.operators import curation, metrics, splits
from quillstone.plans.inputs import MESSAGES, SCORED, guesses, messages, pick, quoted, read, scored, sql_pick
from quillstone.plans.privacy_queries import _LABELED, _SCORES, eval_label, labeled

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns))


@query("agg21_pr_auc", f"""WITH {SCORED}, r AS (SELECT attribute, y, sum(y) OVER w AS tp, count(*) OVER w AS k FROM scored WINDOW w AS (PARTITION BY attribute ORDER BY p DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT attribute, round(coalesce(sum(CASE WHEN y = 1 THEN tp / k::DOUBLE END) / sum(y), 0), 6) AS pr_auc FROM r GROUP BY attribute""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.pr_auc(scored(spark, sf)), "pr_auc")


@query("agg22_roc_auc", f"""WITH {SCORED}, r AS (SELECT attribute, y, rank() OVER (PARTITION BY attribute ORDER BY p) + (count(*) OVER (PARTITION BY attribute, p) - 1) / 2.0 AS k FROM scored),
    s AS (SELECT attribute, sum(k * y) AS r, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM r GROUP BY attribute) SELECT attribute, round((r - a * (a + 1) / 2) / (a * b), 6) AS roc_auc FROM s""")
def _(spark, sf):
    return _rounded(metrics.roc_auc(scored(spark, sf)), "roc_auc")


@query("agg20_23_27_at_threshold", f"""WITH {SCORED}, n AS (SELECT attribute, count(*) FILTER (WHERE p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0)::DOUBLE AS fp,
        count(*) FILTER (WHERE p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0)::DOUBLE AS tn FROM scored GROUP BY attribute)
    SELECT attribute, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(0.5 * (tp / (tp + fn) + tn / (tn + fp)), 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((fp + tn) / (tp + fn), 6) AS pos_weight FROM n""")
def _(spark, sf):
    return _rounded(metrics.at_threshold(scored(spark, sf)), "f1", "balanced_accuracy", "precision", "recall", "pos_weight")


def _sql_calibration(bin_: str) -> str:
    return f"""WITH {SCORED}, b AS (SELECT attribute, {bin_} AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a, sum((p - y) * (p - y)) AS s FROM scored GROUP BY ALL)
        SELECT attribute, round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round(sum(s) / sum(n), 6) AS brier FROM b GROUP BY attribute"""


@query("agg25_binary_calibration", _sql_calibration("greatest(1, ceil(p * 10))"))
def _(spark, sf):
    return _rounded(metrics.calibration(scored(spark, sf), 10, "upper"), "ece", "mce", "brier")


@query("agg26_lower_edge_calibration", _sql_calibration("least(floor(p * 10), 9)"))
def _(spark, sf):
    return _rounded(metrics.calibration(scored(spark, sf), 10, "lower"), "ece", "mce", "brier")


@query("agg24_multiclass_calibration", f"""WITH {SCORED}, b AS (SELECT ceil(p * 15) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS a FROM scored GROUP BY 1)
    SELECT round(sum(CASE WHEN bin > 0 THEN abs(c - a) * n ELSE 0 END) / sum(n), 6) AS ece FROM b""")
def _(spark, sf):
    return _rounded(metrics.multiclass_ece(scored(spark, sf).select(F.col("p").alias("confidence"), F.col("y").alias("hit"))), "ece")


_CURVE = f"""{SCORED}, t AS (SELECT DISTINCT attribute, round(p, 6) AS t FROM scored UNION SELECT DISTINCT attribute, 0.0 FROM scored UNION SELECT DISTINCT attribute, 1.0 FROM scored),
    v AS (SELECT attribute, round(p, 6) AS t, count(*) AS n, sum(y) AS pos FROM scored GROUP BY ALL),
    c AS (SELECT t.attribute, t.t, sum(coalesce(n, 0)) OVER d AS called, sum(coalesce(pos, 0)) OVER d AS tp, sum(coalesce(pos, 0)) OVER (PARTITION BY t.attribute) AS ap FROM t LEFT JOIN v ON v.attribute = t.attribute AND v.t = t.t
        WINDOW d AS (PARTITION BY t.attribute ORDER BY t.t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    curve AS (SELECT attribute, t, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS precision, CASE WHEN ap > 0 THEN tp / ap::DOUBLE ELSE 0 END AS recall FROM c)"""


@query("agg27_threshold_curve", f"WITH {_CURVE} SELECT attribute, t, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def _(spark, sf):
    return _rounded(metrics.threshold_curve(scored(spark, sf)), "precision", "recall")


@query("agg28_fitted_thresholds", f"""WITH {_CURVE}, b AS (SELECT *, max(CASE WHEN recall < 0.90 THEN 1 ELSE 0 END) OVER (PARTITION BY attribute ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM curve),
    e AS (SELECT attribute, min(t) FILTER (WHERE precision >= 0.60) AS reached, first(t ORDER BY precision DESC, t) AS best, coalesce(max(t) FILTER (WHERE broken = 0), 0.0) AS low FROM b GROUP BY attribute)
    SELECT attribute, round(CASE WHEN coalesce(reached, best) - low < 0.05 THEN greatest(0.0, coalesce(reached, best) - 0.05) ELSE low END, 4) AS medium_edge, round(coalesce(reached, best), 4) AS high_edge, reached IS NULL OR low = 0 AS degraded FROM e""")
def _(spark, sf):
    return metrics.fitted_thresholds(scored(spark, sf))


@query("agg29_youden", f"""WITH {SCORED}, g AS (SELECT attribute, unnest(range(1, 92)) AS s FROM (SELECT DISTINCT attribute FROM scored)),
    z AS (SELECT attribute, y, greatest(0, least(91, floor((p - 0.05) * 100 + 1e-9) + 1)) AS steps FROM scored),
    r AS (SELECT g.attribute, s, round(avg(CASE WHEN y = 1 THEN CASE WHEN steps >= s THEN 1.0 ELSE 0.0 END END), 12) AS tpr, round(avg(CASE WHEN y = 0 THEN CASE WHEN steps >= s THEN 1.0 ELSE 0.0 END END), 12) AS fpr FROM g JOIN z ON z.attribute = g.attribute GROUP BY ALL)
    SELECT attribute, round(0.04 + first(s ORDER BY round(fpr - tpr, 12), s) * 0.01, 2) AS high, round(0.04 + first(s ORDER BY round(abs(tpr - 0.85), 12), s) * 0.01, 2) AS medium FROM r GROUP BY attribute""")
def _(spark, sf):
    return metrics.youden_thresholds(scored(spark, sf))


@query("agg30_band_shares", f"""WITH {SCORED} SELECT attribute, round(count(*) FILTER (WHERE p < 0.30) / count(*)::DOUBLE, 4) AS share_low, round(count(*) FILTER (WHERE p >= 0.60) / count(*)::DOUBLE, 4) AS share_high,
    round(count(*) FILTER (WHERE p >= 0.60 AND y = 1) / nullif(count(*) FILTER (WHERE p >= 0.60), 0)::DOUBLE, 4) AS high_precision, round(count(*) FILTER (WHERE p < 0.30 AND y = 1) / nullif(sum(y), 0)::DOUBLE, 4) AS missed FROM scored GROUP BY attribute""")
def _(spark, sf):
    b = V.band(F.col("p"))
    high, low, pos = F.count_if(b == "HIGH"), F.count_if(b == "LOW"), F.sum("y")
    return scored(spark, sf).groupBy("attribute").agg(
        F.round(low / F.count("*"), 4).alias("share_low"), F.round(high / F.count("*"), 4).alias("share_high"),
        F.round(F.count_if((b == "HIGH") & (F.col("y") == 1)) / F.nullif(high, F.lit(0)), 4).alias("high_precision"), F.round(F.count_if((b == "LOW") & (F.col("y") == 1)) / F.nullif(pos, F.lit(0)), 4).alias("missed"),
    )


_SIZES = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {len(x)}" for a, x in P.TAXONOMY.items()) + " END"
_LISTED = "CASE attribute " + " ".join(f"WHEN '{a}' THEN list_contains([{', '.join(map(quoted, x))}], {{0}})" for a, x in P.TAXONOMY.items()) + " END"
_ATTACKED = f"""{_LABELED}, ok AS (SELECT * FROM lab WHERE {_LISTED.format('label')}),
    o AS (SELECT method, attribute, count(*) AS n, avg(CASE WHEN label = guess THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN guess = 'UNKNOWN' THEN 1.0 ELSE 0.0 END) AS abstained FROM ok GROUP BY ALL),
    b AS (SELECT method, attribute, label AS l, CASE WHEN label = guess THEN 1 ELSE 0 END AS tp, 1 AS t, 0 AS g FROM ok UNION ALL SELECT method, attribute, guess, 0, 0, 1 FROM ok),
    f AS (SELECT method, attribute, l, 2.0 * sum(tp) / (sum(t) + sum(g)) AS f FROM b WHERE {_LISTED.format('l')} GROUP BY ALL),
    m AS (SELECT method, attribute, t / ({_SIZES}) AS macro_f1 FROM (SELECT method, attribute, sum(f) AS t FROM f GROUP BY method, attribute)),
    att AS (SELECT o.method, o.attribute, accuracy, abstained, macro_f1, n FROM o JOIN m ON m.method = o.method AND m.attribute = o.attribute)"""


def _attacked(spark, sf):
    return metrics.attack_metrics(guesses(spark, sf), truth="truth", label=eval_label)


@query("agg15_attack_metrics", f"WITH {_ATTACKED} SELECT method, attribute, round(accuracy, 6) AS accuracy, round(abstained, 6) AS abstained, round(macro_f1, 6) AS macro_f1, n FROM att")
def _(spark, sf):
    return _rounded(_attacked(spark, sf), "accuracy", "abstained", "macro_f1")


@query("agg17_reduction_vs_raw", f"WITH {_ATTACKED} SELECT method, attribute, round(accuracy, 6) AS asr, round(max(accuracy) FILTER (WHERE method = 'raw') OVER (PARTITION BY attribute) - accuracy, 6) AS reduction FROM att")
def _(spark, sf):
    raw = F.max(F.when(F.col("method") == "raw", F.col("accuracy"))).over(Window.partitionBy("attribute"))
    return _rounded(_attacked(spark, sf).select("method", "attribute", F.col("accuracy").alias("asr"), (raw - F.col("accuracy")).alias("reduction")), "asr", "reduction")


@query("agg31_class_accuracy", f"""WITH {_LABELED}, n AS (SELECT attribute, label, count(*) AS n FROM lab WHERE method = 'raw' GROUP BY ALL), mj AS (SELECT attribute, first(label ORDER BY n DESC, label) AS majority FROM n GROUP BY attribute)
    SELECT lab.attribute, round(avg(CASE WHEN guess = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN majority = label THEN 1.0 ELSE 0.0 END), 6) AS majority_accuracy, count(DISTINCT guess) AS predicted_classes
    FROM lab JOIN mj ON mj.attribute = lab.attribute WHERE method <> 'raw' GROUP BY lab.attribute""")
def _(spark, sf):
    g = labeled(spark, sf)
    n = g.where("method = 'raw'").groupBy("attribute", "label").agg(F.count("*").alias("n"))
    majority = n.groupBy("attribute").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority"))  # one row for each attribute
    rows = g.where("method <> 'raw'").join(F.broadcast(majority), "attribute")
    hit = lambda c: F.round(F.avg((F.col(c) == F.col("label")).cast("double")), 6)
    return rows.groupBy("attribute").agg(hit("guess").alias("accuracy"), hit("majority").alias("majority_accuracy"), F.countDistinct("guess").alias("predicted_classes"))


# --- spans, verdicts ---

_COMPARE = f"""{_SCORES}, b AS (SELECT conv_id, turn, greatest(age, location, occupation, education) AS before FROM s), a AS (SELECT conv_id, turn, CAST(turn % 4 AS DOUBLE) / 4 AS after, (conv_id + turn) % 5 = 0 AS hard, ((conv_id * 3 + turn) % 10) / 10.0::DOUBLE AS utility FROM msg)"""


@query("arr11_verdicts", f"""WITH {_COMPARE} SELECT b.conv_id, b.turn, round(before - after, 4) AS delta, CASE WHEN hard THEN 'explicit_pii_remains' WHEN round(before - after, 4) <= 0.01 THEN CASE WHEN round(before - after, 4) >= -0.01 THEN 'no_change' ELSE 'worse' END
    WHEN utility < 0.70 THEN 'improved_with_cost' ELSE 'improved' END AS verdict FROM b JOIN a ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def _(spark, sf):
    s = V.rule_scores(F.col("text"))
    rows = messages(spark, sf).select("conv_id", "turn", F.greatest(*s.values()).alias("before"), ((F.col("turn") % 4).cast("double") / 4).alias("after"), ((F.col("conv_id") + F.col("turn")) % 5 == 0).cast("int").alias("hard"), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(10)) / 10.0).alias("utility"))
    delta, verdict = curation.verdict(F.col("before"), F.col("after"), F.col("hard"), F.col("utility"))
    return rows.select("conv_id", "turn", delta.alias("delta"), verdict.alias("verdict"))


@query("top03_top_cues", """WITH c AS (SELECT l_orderkey AS id, l_partkey || ':' || l_linenumber || ':' || CAST(l_quantity AS INTEGER) AS span, round(l_discount * 5, 2) AS importance FROM lineitem),
    r AS (SELECT DISTINCT id, span, importance FROM c WHERE importance >= 0.20), k AS (SELECT id, span, row_number() OVER (PARTITION BY id ORDER BY importance DESC, span) AS k FROM r)
    SELECT id, string_agg(span, ',' ORDER BY k) AS cues FROM k WHERE k <= 5 GROUP BY id""")
def _(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat_ws(":", "l_partkey", "l_linenumber", F.col("l_quantity").cast("int")).alias("span"), F.round(F.col("l_discount") * 5, 2).alias("importance")).distinct()
    w = Window.partitionBy("id").orderBy(F.desc("importance"), "span")
    best = rows.where(F.col("importance") >= P.CUE_FLOOR).withColumn("k", F.row_number().over(w)).where(F.col("k") <= P.MOST_CUES)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "span"))), lambda x: x["span"]), ",").alias("cues"))


@query("top01_best_candidate", f"""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS idx, l_partkey AS cand, round(l_discount * 10, 2) AS risk, l_quantity / 50 AS cosine, l_tax AS utility FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY utility DESC, idx, cand, cosine) AS k FROM c WHERE risk < 0.30 AND cosine >= 0.5) SELECT id, idx, cand, utility FROM k WHERE k = 1""")
def _(spark, sf):
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("cand"), F.round(F.col("l_discount") * 10, 2).alias("risk"), (F.col("l_quantity") / 50).alias("cosine"), F.col("l_tax").alias("utility"))
    return curation.best_candidate(c.where("risk < 0.30 AND cosine >= 0.5"), "id", F.struct(-F.col("utility"), F.col("idx"), F.col("cand"), F.col("cosine"))).select("id", "idx", "cand", "utility")


@query("top02_weighted_candidate", """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS idx, l_partkey AS cand, round(0.45 * l_discount + 0.40 * l_tax + 0.15 * (l_quantity / 50) - 0.10 * (abs(l_quantity - 25) / 25), 9) AS score FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, idx, cand) AS k FROM c) SELECT id, idx, cand, round(score, 6) AS score FROM k WHERE k = 1""")
def _(spark, sf):
    q = F.col("l_quantity")
    score = F.round(curation.pareto_score(F.col("l_discount"), F.col("l_tax"), q / 50, F.abs(q - 25) / 25), 9)
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("cand"), score.alias("score"))
    return curation.best_candidate(c, "id", F.struct(-F.col("score"), F.col("idx"), F.col("cand"))).select("id", "idx", "cand", F.round("score", 6).alias("score"))


@query("top06_identity_quota", """WITH t AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS accepted, md5(CAST(o_orderkey AS VARCHAR) || ':42') AS h FROM orders), q AS (SELECT CAST(round(count(*) FILTER (WHERE accepted) * 0.1 / 0.9) AS BIGINT) AS n FROM t),
    k AS (SELECT id, row_number() OVER (ORDER BY h, id) AS k FROM t WHERE NOT accepted) SELECT id FROM k, q WHERE k <= n""")
def _(spark, sf):
    t = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("accepted"))
    return curation.identity_quota(t.where("accepted"), t.where("NOT accepted"), 0.1, seed=42).select("id")


@query("top05_seeded_sample", "SELECT o_orderkey AS id FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey LIMIT 100")
def _(spark, sf):
    return splits.seeded_sample(read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), "id", 100, seed=7)


@query("top09_most_common", "SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "custkey").limit(10)


@query("top10_lru_overflow", "WITH s AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), k AS (SELECT user_id, row_number() OVER (ORDER BY last_seen, user_id) AS k, count(*) OVER () AS n FROM s) SELECT user_id FROM k WHERE k <= n - 40")
def _(spark, sf):
    seen = read(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return splits.oldest_beyond(seen, 40, F.struct("last_seen", "user_id")).select("user_id")


# --- splits ---

_SPLIT = """p AS (SELECT c_custkey AS id, c_mktsegment AS stratum, md5(CAST(c_custkey AS VARCHAR) || ':42') AS h FROM customer),
    k AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, id) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM p),
    c AS (SELECT *, greatest(1, CAST(round(n * 0.7) AS BIGINT)) AS a, CAST(round(n * 0.15) AS BIGINT) AS b FROM k),
    z AS (SELECT id, stratum, k, CASE WHEN a + b >= n AND n >= 3 THEN n - 2 ELSE a END AS a, CASE WHEN a + b >= n AND n >= 3 THEN 1 ELSE b END AS b FROM c),
    split AS (SELECT id, stratum, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM z)"""


def _profiles(spark, sf):
    return splits.stratified(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("stratum")), "id", "stratum", seed=42)


@query("smp01_stratified_split", f"WITH {_SPLIT} SELECT id, stratum, split FROM split")
def _(spark, sf):
    return _profiles(spark, sf)


@query("flt01_train_filter", f"WITH {_SPLIT} SELECT o_orderstatus AS status, count(*) FILTER (WHERE split = 'train') AS kept, count(*) FILTER (WHERE split IS NULL OR split <> 'train') AS rejected FROM orders LEFT JOIN split ON split.id = o_custkey GROUP BY 1")
def _(spark, sf):
    train = _profiles(spark, sf).where("split = 'train'").select(F.col("id").alias("o_custkey"), F.lit(True).alias("kept"))
    rows = read(spark, sf, "orders").join(train, "o_custkey", "left")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.col("kept")).alias("kept"), F.count_if(F.col("kept").isNull()).alias("rejected"))


@query("join01_semi", f"WITH {_SPLIT} SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT id FROM split WHERE split = 'val')")
def _(spark, sf):
    keep = _profiles(spark, sf).where("split = 'val'").select(F.col("id").alias("o_custkey"))
    return read(spark, sf, "orders").join(keep, "o_custkey", "left_semi").select("o_orderkey")


@query("join02_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("flt17_split_checks", f"WITH {_SPLIT} SELECT count(*) AS profiles, count(DISTINCT id) AS distinct_profiles, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test, count(*) - count(DISTINCT id) AS overlap FROM split")
def _(spark, sf):
    s = F.col("split")
    return _profiles(spark, sf).agg(F.count("*").alias("profiles"), F.countDistinct("id").alias("distinct_profiles"), *(F.count_if(s == x).alias(x) for x in ("train", "val", "test")), (F.count("*") - F.countDistinct("id")).alias("overlap"))


@query("src12_last_write_wins", "WITH k AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, value FROM k WHERE k = 1")
def _(spark, sf):
    return splits.last_write(read(spark, sf, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "value")


@query("win11_first_per_key", "WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, event_id, event_type FROM k WHERE k = 1")
def _(spark, sf):
    return splits.first_write(read(spark, sf, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("join04_cyclic", """WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, count(*) OVER () AS n FROM customer WHERE c_mktsegment = 'BUILDING'),
    i AS (SELECT unnest(range(0, 500)) AS i) SELECT i, c_custkey FROM i JOIN p ON rn = i % n""")
def _(spark, sf):
    people = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return splits.cyclic(people, "c_custkey", 500)


@query("set02_disjoint", f"WITH {_SPLIT} SELECT count(*) AS shared FROM (SELECT id FROM split WHERE split = 'train' INTERSECT SELECT id FROM split WHERE split = 'test')")
def _(spark, sf):
    p = _profiles(spark, sf)
    return p.where("split = 'train'").select("id").intersect(p.where("split = 'test'").select("id")).agg(F.count("*").alias("shared"))


@query("set01_union", "SELECT kind, count(*) AS n FROM (SELECT 'accepted' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'no_op' FROM orders WHERE o_orderstatus = 'O') GROUP BY kind")
def _(spark, sf):
    o = read(spark, sf, "orders")
    part = lambda status, kind: o.where(F.col("o_orderstatus") == status).select(F.lit(kind).alias("kind"))
    return part("F", "accepted").unionByName(part("O", "no_op")).groupBy("kind").agg(F.count("*").alias("n"))


# --- study summaries ---

@query("agg02_05_rates", "SELECT event_type, round(count(*) FILTER (WHERE value > 10) / count(*)::DOUBLE, 4) AS over_ten, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").groupBy("event_type").agg(
        metrics.rate(v > 10).alias("over_ten"), F.round(F.avg(v), 4).alias("mean"), F.round(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(v, F.lit(0.95)), 4).alias("p95"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n")
    )


@query("agg12_by_scenario_and_total", "SELECT coalesce(event_type, 'ALL') AS scenario, count(*) AS n, count(DISTINCT user_id) AS participants, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type), ())")
def _(spark, sf):
    return read(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("participants"), F.round(F.avg("value"), 6).alias("mean")).select(F.coalesce("event_type", F.lit("ALL")).alias("scenario"), "n", "participants", "mean")


@query("agg13_distinct_lists", "SELECT event_type, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS ids FROM events GROUP BY 1")
def _(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.array_join(F.array_sort(F.collect_set("user_id")), ",").alias("ids"))


@query("arr09_json_profile", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))




@query("agg07_disclosure", f"""WITH a AS (SELECT o_orderkey AS id, ['a', 'b', 'c', 'd'][1:CAST(o_orderkey % 5 AS INTEGER)] AS available, ['b', 'd', 'x'][1:CAST(o_custkey % 4 AS INTEGER)] AS used FROM orders)
    SELECT count(*) AS n, round(avg(len(list_intersect(used, available)) / len(available)::DOUBLE), 6) AS mean, round(median(len(list_intersect(used, available)) / len(available)::DOUBLE), 6) AS median FROM a WHERE len(available) > 0""")
def _(spark, sf):
    o = read(spark, sf, "orders")
    some = lambda values, n: F.slice(F.array(*map(F.lit, values)), F.lit(1), n.cast("int"))
    rows = o.select(some("abcd", F.col("o_orderkey") % 5).alias("available"), some("bdx", F.col("o_custkey") % 4).alias("used")).where(F.size("available") > 0)
    share = F.size(F.array_intersect(F.array_distinct("used"), F.array_distinct("available"))) / F.size("available")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(share), 6).alias("mean"), F.round(F.percentile(share, F.lit(0.5)), 6).alias("median"))


@query("agg36_content_hash", "SELECT event_type, sha256(string_agg(CAST(event_id AS VARCHAR), chr(10) ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def _(spark, sf):
    return curation.content_hash(read(spark, sf, "events"), "event_type", "event_id", F.col("event_id").cast("string"))


@query("prj03_prompts", f"""WITH o AS (SELECT o_orderkey AS id, {sql_pick(P.PROMPT_TEMPLATES, 'o_orderkey')} AS t, {sql_pick(tuple(P.AGE_PHRASES.values()), 'o_custkey')} AS a, {sql_pick(tuple(P.EDUCATION_PHRASES.values()), 'o_custkey')} AS e,
    {sql_pick(tuple(P.OCCUPATION_PHRASES.values()), 'o_custkey')} AS o, {sql_pick(tuple(P.LOCATION_PHRASES.values()), 'o_custkey')} AS l FROM orders)
    SELECT id, replace(replace(replace(replace(t, '{{age_phrase}}', a), '{{education_phrase}}', e), '{{occupation}}', o), '{{location_phrase}}', l) AS prompt FROM o""")
def _(spark, sf):
    o = read(spark, sf, "orders")
    tables = {"age": P.AGE_PHRASES, "education": P.EDUCATION_PHRASES, "occupation": P.OCCUPATION_PHRASES, "location": P.LOCATION_PHRASES}
    labels = {a: pick(tuple(t), F.col("o_custkey")) for a, t in tables.items()}
    return o.select(F.col("o_orderkey").alias("id"), V.rendered_prompt(pick(P.PROMPT_TEMPLATES, F.col("o_orderkey")), labels).alias("prompt"))


@query("str39_attack_success", None)
def _(spark, sf):
    g = guesses(spark, sf, deal=100_000)
    return g.select("id", "attribute", V.attack_success(F.col("guess"), F.col("truth")).alias("hit"))


@query("win12_entity_tokens", f"""WITH {MESSAGES}, f AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, {quoted(P.SESSION_ENTITIES['ORGANIZATION'])})) AS s FROM msg), k AS (SELECT conv_id, lower(s) AS s, min(turn) AS first_turn FROM f GROUP BY ALL)
    SELECT conv_id, s AS surface, 'ORG_' || row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, s) AS token FROM k""")
def _(spark, sf):
    found = messages(spark, sf).select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(P.SESSION_ENTITIES["ORGANIZATION"]), F.lit(0))).alias("s"))
    first = found.groupBy("conv_id", F.lower("s").alias("surface")).agg(F.min("turn").alias("first_turn"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "surface"))
    return first.select("conv_id", "surface", F.concat(F.lit("ORG_"), n).alias("token"))
