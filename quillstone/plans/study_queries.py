"""Queries over study records. The records are derived from `orders` by arithmetic that both engines share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.operators import study as S
from quillstone.sources.tables import shared_folder
from quillstone.plans.inputs import read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _cases(index: str, *values: str | None) -> str:
    """The value number index, as text that both engines read."""
    return f"CASE {index} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None) + " END"


_FIELDS = {
    "id": "o_orderkey", "scenario": _cases("o_custkey", "S1", "S2", "S3"),
    "decision": _cases("(o_orderkey + o_custkey)", "accept", "use_with_edits", "would_not_use", "not_applicable", "later", None, "would_use"),
    "comprehension": _cases("o_orderkey", "correct", "partial", "incorrect", "echo", None, "unclear"), "understood": "o_custkey % 3 = 0",
    "detected": "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END", "risk_score": "CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey % 101) / CAST(100 AS DOUBLE) END",
    "state": _cases("o_custkey", "risk_negative_passthrough", "rewritten", "blocked", None), "would_use": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN true WHEN 2 THEN true ELSE false END",
    "usefulness": "CAST(nullif(o_orderkey % 6, 0) AS DOUBLE)", "latency_s": "CAST(NULL AS DOUBLE)", "latency": "CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 37) / CAST(4 AS DOUBLE) END",
    "client_latency": "CAST(o_custkey % 9 AS DOUBLE)", "query_seconds": "CAST(o_custkey % 61 AS DOUBLE)", "decision_seconds": "CASE WHEN o_orderkey % 7 > 1 THEN CAST(o_orderkey % 29 AS DOUBLE) END",
    "deviation": "o_custkey % 11 = 0", "intervention": "o_custkey % 17 = 0", "deviation_type": _cases("o_orderkey", "late", "skipped", None),
    "risk_before": "CASE WHEN o_orderkey % 8 > 0 THEN (o_orderkey % 97) / CAST(97 AS DOUBLE) END", "risk_after": "CASE WHEN o_custkey % 9 > 0 THEN (o_custkey % 89) / CAST(89 AS DOUBLE) END",
    "risk_delta": "CAST(NULL AS DOUBLE)", "utility_score": "(o_custkey % 71) / CAST(71 AS DOUBLE)", "cosine": "CASE WHEN o_custkey % 3 > 0 THEN (o_orderkey % 53) / CAST(53 AS DOUBLE) END",
    "contradiction": "(o_orderkey % 19) / CAST(19 AS DOUBLE)", "turn_risk": "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 31) / CAST(31 AS DOUBLE) END",
    "cumulative_risk": "CASE WHEN o_custkey % 4 = 0 THEN (o_custkey % 23) / CAST(23 AS DOUBLE) END",
}
_PLAIN = ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items())
STUDY = f"""study AS (SELECT {_PLAIN}, CASE o_orderkey % 4 WHEN 0 THEN ['F08'] WHEN 1 THEN ['F01', 'F08'] WHEN 2 THEN CAST([] AS VARCHAR[]) END AS failure_modes,
    CASE WHEN o_orderkey % 5 = 0 THEN [{{'t': (o_custkey % 7) / 7.0::DOUBLE, 'c': NULL::DOUBLE}}, {{'t': NULL::DOUBLE, 'c': (o_custkey % 5) / 5.0::DOUBLE}}] END AS turns FROM orders)"""


def records(spark, sf):
    modes = "CASE o_orderkey % 4 WHEN 0 THEN array('F08') WHEN 1 THEN array('F01', 'F08') WHEN 2 THEN cast(array() AS array<string>) END AS failure_modes"
    part = "named_struct('turn_risk', {}, 'cumulative_risk', {})"
    none = "cast(null AS double)"
    turns = f"CASE WHEN o_orderkey % 5 = 0 THEN array({part.format('(o_custkey % 7) / cast(7 AS double)', none)}, {part.format(none, '(o_custkey % 5) / cast(5 AS double)')}) END AS turns"
    return read(spark, sf, "orders").selectExpr(*(f"{v} AS {k}" for k, v in _FIELDS.items()), modes, turns)


def _rate(n: str, total: str) -> str:
    return f"round(({n}) / nullif({total}, 0)::DOUBLE, 4)"


def _n(words) -> str:
    return "count(*) FILTER (WHERE decision IN (" + ", ".join(f"'{w}'" for w in words) + "))"


_ACC, _ED, _RE, _NA = _n(S.ACCEPT), _n(S.EDIT), _n(S.REJECT), _n(S.NOT_APPLICABLE)
_TOT = f"(count(decision) - {_NA})"
_DECISIONS = f"""{_TOT} AS total, count(decision) AS observed, {_ACC} AS accept, {_ED} AS accept_with_edits, {_RE} AS reject, {_NA} AS not_applicable, {_TOT} - {_ACC} - {_ED} - {_RE} AS other,
    {_rate(f'{_ACC} + {_ED}', _TOT)} AS acceptance_rate, {_rate(_ACC, _TOT)} AS as_is_rate, {_rate(_ED, _TOT)} AS edit_rate, {_rate(_RE, _TOT)} AS rejection_rate"""


@query("agg05_decisions", f"WITH {STUDY} SELECT scenario, {_DECISIONS} FROM study GROUP BY scenario")
def _(spark, sf):
    return S.grouped(records(spark, sf), S.decisions(), "scenario")


@query("agg06_comprehension", f"WITH {STUDY}, d AS (SELECT unnest(['correct', 'echo', 'incorrect', 'partial']) AS label) SELECT 'categorical' AS kind, d.label, count(s.id) AS n, round(count(s.id) / (SELECT count(*) FROM study WHERE comprehension IN ('correct', 'echo', 'incorrect', 'partial'))::DOUBLE, 4) AS rate FROM d LEFT JOIN study s ON s.comprehension = d.label GROUP BY d.label")
def _(spark, sf):
    return S.comprehension(records(spark, sf))


@query("agg06_comprehension_legacy", f"WITH {STUDY} SELECT 'boolean' AS kind, CASE WHEN understood THEN 'correct' ELSE 'incorrect' END AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM study)::DOUBLE, 4) AS rate FROM study GROUP BY understood")
def _(spark, sf):
    return S.comprehension(records(spark, sf).withColumn("comprehension", F.lit("unclear")))


@query("agg08_detection_adoption_latency", f"""WITH {STUDY} SELECT scenario, count(detected) AS evaluated, count(*) FILTER (WHERE detected) AS detected, {_rate('count(*) FILTER (WHERE detected)', 'count(detected)')} AS detected_rate,
    round(avg(risk_score), 4) AS score_mean, round(median(risk_score), 4) AS score_median, count(would_use) AS adoption_evaluated, count(*) FILTER (WHERE would_use) AS would_use,
    count(*) FILTER (WHERE NOT would_use) AS would_not_use, {_rate('count(*) FILTER (WHERE would_use)', 'count(would_use)')} AS adoption_rate, count(usefulness) AS usefulness_n, round(avg(usefulness), 4) AS usefulness_mean,
    round(median(usefulness), 4) AS usefulness_median, round(avg(latency), 4) AS latency_mean, round(median(latency), 4) AS latency_median, round(avg(query_seconds), 4) AS query_mean,
    round(median(query_seconds), 4) AS query_median, round(avg(decision_seconds), 4) AS decision_mean, round(median(decision_seconds), 4) AS decision_median FROM study GROUP BY scenario""")
def _(spark, sf):
    return S.grouped(records(spark, sf), S.detection() | S.adoption() | S.usefulness() | S.latency(), "scenario")


@query("agg08_protocol_failures", f"""WITH {STUDY} SELECT count(*) AS records, count(*) FILTER (WHERE deviation) AS deviations, {_rate('count(*) FILTER (WHERE deviation)', 'count(*)')} AS deviation_rate,
    count(*) FILTER (WHERE intervention) AS interventions, {_rate('count(*) FILTER (WHERE intervention)', 'count(*)')} AS intervention_rate, count(*) FILTER (WHERE len(failure_modes) > 0) AS with_failure,
    {_rate('count(*) FILTER (WHERE len(failure_modes) > 0)', 'count(*)')} AS failure_rate, CAST(sum(len(list_filter(coalesce(failure_modes, []), x -> x = 'F08'))) AS BIGINT) AS trust_failures,
    {_rate("sum(len(list_filter(coalesce(failure_modes, []), x -> x = 'F08')))", 'count(*)')} AS trust_failure_rate FROM study""".replace("x -> ", "lambda x: "))
def _(spark, sf):
    return S.grouped(records(spark, sf), S.protocol() | S.failures())


@query("agg08_system_states", f"WITH {STUDY} SELECT state AS label, count(*) AS n, round(count(*) / (SELECT count(state) FROM study)::DOUBLE, 4) AS rate FROM study WHERE state IS NOT NULL GROUP BY state")
def _(spark, sf):
    return S.label_counts(records(spark, sf), F.col("state"), share=True)


@query("agg08_failure_labels", f"WITH {STUDY} SELECT label, count(*) AS n FROM (SELECT unnest(failure_modes) AS label FROM study UNION ALL SELECT deviation_type FROM study WHERE deviation) WHERE label IS NOT NULL GROUP BY label")
def _(spark, sf):
    r = records(spark, sf)
    both = r.select(F.explode("failure_modes").alias("l")).unionByName(r.where("deviation").select(F.col("deviation_type").alias("l")))
    return S.label_counts(both, F.col("l"))


@query("agg09_privacy", f"""WITH {STUDY} SELECT scenario, round(avg(risk_before), 4) AS before_mean, round(avg(risk_after), 4) AS after_mean, round(avg(risk_before - risk_after), 4) AS delta_mean,
    round(median(risk_before - risk_after), 4) AS delta_median, count(*) FILTER (WHERE risk_before - risk_after < 0) AS inversions,
    {_rate('count(*) FILTER (WHERE risk_before - risk_after < 0)', 'count(risk_before - risk_after)')} AS inversion_rate FROM study GROUP BY scenario""")
def _(spark, sf):
    return S.grouped(records(spark, sf), S.privacy(), "scenario")


@query("agg09_privacy_given_deltas", f"WITH {STUDY} SELECT round(avg(risk_before), 4) AS before_mean, round(avg(risk_after), 4) AS after_mean, round(avg(utility_score), 4) AS delta_mean, round(median(utility_score), 4) AS delta_median, count(*) FILTER (WHERE risk_before < risk_after) AS inversions, {_rate('count(*) FILTER (WHERE risk_before < risk_after)', 'count(risk_before - risk_after)')} AS inversion_rate FROM study")
def _(spark, sf):
    return S.grouped(records(spark, sf), S.privacy(delta="utility_score"))


_UTILITY = ("utility_score", "cosine", "contradiction")


@query("agg10_utility", f"WITH {STUDY} SELECT " + ", ".join(f"round(avg({f}), 4) AS {f}_mean, round(median({f}), 4) AS {f}_median" for f in _UTILITY) + " FROM study")
def _(spark, sf):
    return S.grouped(records(spark, sf), S.utility(_UTILITY))


@query("agg11_multiturn", f"""WITH {STUDY}, v AS (SELECT id, turn_risk AS t, cumulative_risk AS c FROM study UNION ALL SELECT id, u.t, u.c FROM (SELECT id, unnest(turns) AS u FROM study))
    SELECT count(DISTINCT id) FILTER (WHERE t IS NOT NULL OR c IS NOT NULL) AS records, round(avg(t), 4) AS turn_mean, round(max(t), 4) AS turn_max, round(avg(c), 4) AS cumulative_mean, round(max(c), 4) AS cumulative_max FROM v""")
def _(spark, sf):
    return S.multiturn(records(spark, sf))


@query("snk03_metric_csv", f"WITH {STUDY} SELECT unnest(['observed', 'accept', 'reject']) AS metric, unnest([CAST(count(decision) AS VARCHAR), CAST({_ACC} AS VARCHAR), CAST({_RE} AS VARCHAR)]) AS value FROM study")
def _(spark, sf):
    """Written as CSV and as JSON, and read back from the CSV."""
    row = S.grouped(records(spark, sf), {k: c for k, c in S.decisions().items() if k in ("observed", "accept", "reject")})
    path = f"{shared_folder(spark)}-{uuid.uuid4().hex[:6]}"
    row.write.json(f"{path}/json")
    S.as_metrics(row).write.option("header", True).csv(f"{path}/csv")
    return spark.read.option("header", True).schema("metric string, value string").csv(f"{path}/csv")


@query("join03_by_id", f"WITH {STUDY} SELECT a.id, a.decision, b.l_n FROM study a JOIN (SELECT l_orderkey, count(*) AS l_n FROM lineitem GROUP BY 1) b ON b.l_orderkey = a.id WHERE a.decision IS NOT NULL")
def _(spark, sf):
    judged = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("l_n"))
    return records(spark, sf).where("decision IS NOT NULL").select("id", "decision").join(judged, "id")


@query("join05_zip", "WITH z AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(length(text) ORDER BY turn) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, unnest(range(len(r))) AS position, unnest(r) AS role, unnest(n) AS chars FROM z")
def _(spark, sf):
    """Three lists of a conversation, one beside the other by position."""
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("chars")))).alias("s"))
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("s") - 1).cast("array<long>").alias("position"), F.col("s")["role"].alias("role"), F.col("s")["chars"].alias("chars"))
    return c.select("conv_id", F.explode(zipped).alias("z")).select("conv_id", "z.position", "z.role", "z.chars")


@query("agg16_19_by_class", f"""WITH {STUDY}, t AS (SELECT scenario, decision IN ('accept', 'would_use') AS hit_a, would_use AS hit_b FROM study WHERE decision IS NOT NULL AND would_use IS NOT NULL), g AS (
    SELECT scenario, count(*) AS n, round(avg(hit_a::INT), 4) AS first_rate, round(avg(hit_b::INT), 4) AS second_rate FROM t GROUP BY scenario) SELECT *, round(second_rate - first_rate, 4) AS delta FROM g""")
def _(spark, sf):
    """Success by class for two variants of one record, and their difference."""
    r = records(spark, sf).where("decision IS NOT NULL AND would_use IS NOT NULL").withColumn("a", F.col("decision").isin("accept", "would_use").cast("int"))
    out = r.groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.avg("a"), 4).alias("first_rate"), F.round(F.avg(F.col("would_use").cast("int")), 4).alias("second_rate"))
    return out.withColumn("delta", F.round(F.col("second_rate") - F.col("first_rate"), 4))
