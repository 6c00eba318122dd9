"""Queries of sessions that a stream keeps: guarded conversations and the capped session table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.operators.spans import SESSION_PREFIX
from quillstone.plans.inputs import MESSAGES, messages, quoted, read
from quillstone.plans.privacy_queries import _sql_cascade, _sql_chain
from quillstone.sources.tables import shared_folder
from quillstone.streaming import guard, store

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


_COLUMNS = ["conv_id", "turn", "turn_number", "tokens", "entities", *P.ATTRIBUTES, "leakage_before", "leakage"]
_GUESS = ", ".join(f"{_sql_cascade(f'lower({t})', (*P.ATTACK_LABELS[a], ('UNKNOWN', ())))} AS {n}_{a}" for t, n in (("text", "before"), ("served", "after")) for a in P.ATTRIBUTES)
_LABELS = ", ".join(f"{{'a': '{a}', 'l': {quoted(x)}, 'k': {len(ls)}}}" for a, ls in P.TAXONOMY.items() for x in ls)


def _of(when: str) -> str:
    return "CASE x.a " + " ".join(f"WHEN '{a}' THEN {when}_{a}" for a in P.ATTRIBUTES) + " END"


def _weight(when: str) -> str:
    return f"CASE WHEN {when} = 'UNKNOWN' THEN 0.0 ELSE 0.60 * ln((CASE WHEN {when} = label THEN 0.60 ELSE 0.40::DOUBLE / (k - 1) END) * k) END"


_ENTITIES = " UNION ALL ".join(f"SELECT conv_id, turn, text, '{k}' AS kind, '{SESSION_PREFIX[k]}' AS prefix, unnest(regexp_extract_all(text, {quoted('(?i)' + p)})) AS surface FROM u" for k, p in P.SESSION_ENTITIES.items())
_RUN = "PARTITION BY conv_id, attribute, label ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND"
#: Leakage as in the batch windows; the peek adds the written text's evidence to what earlier served turns have left.
_GUARD = f"""WITH {MESSAGES}, u AS (SELECT *, {_sql_chain("text", P.PLACEHOLDERS)} AS served FROM msg WHERE role = 'user'), g AS (SELECT conv_id, turn, {_GUESS} FROM u),
    t AS (SELECT unnest([{_LABELS}]) AS x), d AS (SELECT conv_id, turn, x.a AS attribute, x.l AS label, x.k AS k, {_of("before")} AS gb, {_of("after")} AS ga FROM g, t),
    ev AS (SELECT conv_id, turn, attribute, label, k, {_weight("gb")} AS eb, {_weight("ga")} AS ea FROM d),
    lg AS (SELECT conv_id, turn, attribute, k, unnest([{{'w': 'before', 'lp': coalesce(sum(ea) OVER ({_RUN} 1 PRECEDING), 0) + eb}}, {{'w': 'after', 'lp': sum(ea) OVER ({_RUN} CURRENT ROW)}}]) AS y FROM ev),
    ex AS (SELECT conv_id, turn, attribute, k, y.w AS w, exp(y.lp - max(y.lp) OVER (PARTITION BY conv_id, turn, attribute, y.w)) AS x FROM lg),
    ps AS (SELECT conv_id, turn, attribute, k, w, x / sum(x) OVER (PARTITION BY conv_id, turn, attribute, w) AS p FROM ex),
    i AS (SELECT conv_id, turn, attribute, w, any_value(k) AS k, list_sort(list(p), 'DESC') AS r, -sum(p * ln(greatest(p, 1e-12))) / ln(any_value(k)) AS h FROM ps GROUP BY ALL),
    raw AS (SELECT conv_id, turn, attribute, w, greatest(0.0, least(1.0, greatest(0.0, (r[1] - 1.0 / k) / (1 - 1.0 / k)) * (0.5 * (1 - greatest(0.0, least(1.0, h))) + 0.5 * (r[1] - r[2])))) AS q FROM i),
    ui AS (SELECT conv_id, turn, attribute, w, round(CASE WHEN q < 0.30 THEN 0.30 * (q / 0.30) WHEN q < 0.60 THEN 0.30 + 0.30 * ((q - 0.30) / 0.30) ELSE 0.60 + 0.40 * ((q - 0.60) / 0.40) END, 4) AS s FROM raw),
    lw AS (SELECT conv_id, turn, w, list_sort(list(s), 'DESC') AS r FROM ui GROUP BY ALL),
    ll AS (SELECT conv_id, turn, max(z) FILTER (WHERE w = 'before') AS zb, max(z) FILTER (WHERE w = 'after') AS za FROM (SELECT *, round(sqrt((r[1] * r[1] + r[2] * r[2]) / 2), 4) AS z FROM lw) GROUP BY ALL),
    leak AS (SELECT conv_id, turn, row_number() OVER c AS turn_number, greatest(zb, coalesce(max(za) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS leakage_before,
        max(za) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leakage FROM ll WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
    now AS (SELECT conv_id, turn, {", ".join(f"max(s) FILTER (WHERE attribute = '{a}' AND w = 'after') AS {a}" for a in P.ATTRIBUTES)} FROM ui GROUP BY ALL),
    e AS (SELECT conv_id, turn, kind, prefix, regexp_replace(lower(trim(surface)), '\\s+', ' ', 'g') AS name, min(instr(lower(text), lower(surface))) AS pos FROM ({_ENTITIES}) GROUP BY ALL),
    f AS (SELECT conv_id, kind, prefix, name, arg_min(turn, turn * 100000000 + pos) AS first, min(turn * 100000000 + pos) AS place FROM e GROUP BY ALL),
    n AS (SELECT *, prefix || '_' || row_number() OVER (PARTITION BY conv_id, prefix ORDER BY place) AS token FROM f),
    tk AS (SELECT e.conv_id, e.turn, string_agg(token, ',' ORDER BY pos) AS tokens FROM e JOIN n USING (conv_id, kind, name) GROUP BY ALL),
    ne AS (SELECT leak.conv_id, turn, (SELECT count(*) FROM n WHERE n.conv_id = leak.conv_id AND n.first <= leak.turn) AS entities FROM leak)
    SELECT conv_id, turn, turn_number, coalesce(tokens, '') AS tokens, entities, {", ".join(f"round({a}, 3) AS {a}" for a in P.ATTRIBUTES)}, round(leakage_before, 3) AS leakage_before, round(leakage, 3) AS leakage
    FROM leak JOIN now USING (conv_id, turn) JOIN ne USING (conv_id, turn) LEFT JOIN tk USING (conv_id, turn)"""


@query("stm02_guarded_conversations", _GUARD)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn through the guard, as a stream: turns come in up to six micro-batches, every seventh of the early ones
    a batch too late, and are taken in the order of their times. A last event far in the future lets the watermark pass."""
    source, out, state = (shared_folder(spark) for _ in range(3))
    served = V.attack_labels(V.placeholders(F.col("text")))
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60 + F.col("conv_id") % 50)
    users = messages(spark, sf).where("role = 'user'").select("conv_id", "turn", "text", ts.alias("ts"))
    rows = guard.prepared(users, "text", served, V.attack_labels(F.col("text")))
    late = (F.col("turn") < 8) & (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) == 0)
    dealt = rows.withColumn("batch", F.least(F.expr("turn div 2"), F.lit(4)) + late.cast("int"))
    dealt.write.partitionBy("batch").parquet(f"{source}-dealt")
    dealt = spark.read.parquet(f"{source}-dealt")
    end = spark.createDataFrame([(-1, 0, "", "", "", "")], "conv_id long, turn long, kinds string, names string, before string, after string").withColumn("ts", F.timestamp_seconds(F.lit(4_000_000_000)))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    guard.keyed_state(spark)
    try:
        for batch in range(7):  # each run goes on from the checkpoint of the one before, as a job that was started anew
            new = end.select(*rows.columns) if batch == 6 else dealt.where(F.col("batch") == batch).drop("batch").coalesce(4)
            new.write.parquet(f"{source}/batch={batch}")
            stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(source)
            q = guard.guarded(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(guard.OUTPUT).parquet(out)
    return found.select(*_COLUMNS[:5], *(F.round(c, 3).alias(c) for c in _COLUMNS[5:]))


_CAP, _TTL, _ROUNDS = 40, 30 * 86_400_000_000, 4


def _rounds() -> str:
    """The replay of the capped table in SQL, a round after the other."""
    ctes = [f"ev AS (SELECT user_id AS session, epoch_us(ts) AS seen, CAST(event_id % {_ROUNDS} AS INTEGER) AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)", "v0 AS (SELECT NULL::BIGINT AS session, 0::BIGINT AS events, 0::BIGINT AS last_seen WHERE false)"]
    for b in range(_ROUNDS):
        ctes.append(f"n{b} AS (SELECT session, count(*) AS n, max(seen) AS seen FROM ev WHERE b = {b} GROUP BY session)")
        ctes.append(f"m{b} AS (SELECT session, coalesce(events, 0) + coalesce(n, 0) AS events, greatest(coalesce(last_seen, seen), coalesce(seen, last_seen)) AS last_seen FROM v{b} FULL JOIN n{b} USING (session))")
        ctes.append(f"v{b + 1} AS (SELECT * FROM (SELECT * FROM m{b} WHERE (SELECT max(last_seen) FROM m{b}) - last_seen <= {_TTL}) QUALIFY row_number() OVER (ORDER BY last_seen DESC, session DESC) <= {_CAP})")
    return f"WITH {', '.join(ctes)} SELECT session, CAST(events AS BIGINT) AS events, last_seen FROM v{_ROUNDS}"


@query("stm05_session_cap", _rounds())
def _(spark, sf):
    """Sessions (users of events) that are open after a stream of four micro-batches, capped at forty, as the limit is the
    feature: whoever was put out starts anew when seen again."""
    source, table, state = (shared_folder(spark) for _ in range(3))
    events = read(spark, sf, "events").select(F.col("user_id").cast("long").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % _ROUNDS).cast("int").alias("round"))
    sessions = store.SessionTable(spark, table, cap=_CAP, ttl=_TTL)
    last = -1
    for b in range(_ROUNDS):
        events.where(F.col("round") == b).drop("round").write.mode("append").parquet(f"{source}/round={b}")
        stream = spark.readStream.schema("session long, at long").option("recursiveFileLookup", "true").parquet(source)
        q = stream.writeStream.foreachBatch(sessions.advance).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
        last = max([last, *(p["batchId"] for p in q.recentProgress if p["numInputRows"])])
    return sessions.version(last).select("session", "events", "last_seen")
