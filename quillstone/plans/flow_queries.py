"""Queries of whole flows: rewriting, spans, pseudonyms, streams, files, record checks. Those that SQL cannot express have
no SQL and are tested against plain Python on small inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import curation, rewriting, spans
from quillstone.plans.inputs import MESSAGES, SHORT, messages, quoted, read, sentences
from quillstone.plans.privacy_queries import _LEAK_COLUMNS, LEAK, turn_scores
from quillstone.sources import files
from quillstone.sources.tables import shared_folder
from quillstone.streaming.sessions import leakage_stream

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("str18_pruned")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(spark, sf).select("conv_id", "turn", rewriting.pruned(F.concat_ws(" ", "text", "other")).alias("pruned"))


@query("str17_candidates")
def _(spark, sf):
    return rewriting.with_candidates(sentences(spark, sf)).select("conv_id", "turn", F.posexplode_outer("candidates").alias("pos", "candidate"))


@query("str17_diverse_candidates")
def _(spark, sf):
    return rewriting.with_diverse_candidates(sentences(spark, sf)).select("conv_id", "turn", F.posexplode_outer("candidates").alias("pos", "candidate"))


@query("udf11_selected_rewrite")
def _(spark, sf):
    return rewriting.selected(sentences(spark, sf), ["conv_id", "turn"])


@query("str07_explicit_spans")
def _(spark, sf):
    rows = messages(spark, sf).select("conv_id", "turn", F.explode(spans.explicit_spans(F.col("text"))).alias("s"))
    return rows.select("conv_id", "turn", "s.type", "s.start", "s.end", F.sha2("s.surface", 256).alias("surface_sha256"))


@query("arr03_04_redact_by_spans")
def _(spark, sf):
    rows = messages(spark, sf).select("conv_id", "turn", "text", spans.without_overlaps(spans.explicit_spans(F.col("text")), spans.longest_first).alias("s"))
    tags = F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<"), s["type"], F.lit(">")).alias("token")))
    return rows.select("conv_id", "turn", spans.spliced(F.col("text"), tags).alias("redacted"))


@query("arr10_spans_by_type", f"WITH {MESSAGES}, f AS (" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS type, len(regexp_extract_all(text, {quoted(p)})) AS n FROM msg" for k, p in P.EXPLICIT.items()) + ") SELECT type, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY type HAVING sum(n) > 0")
def _(spark, sf):
    return messages(spark, sf).select(F.explode(spans.explicit_spans(F.col("text"))).alias("s")).groupBy("s.type").agg(F.count("*").alias("n"))


@query("str23_pseudonyms")
def _(spark, sf):
    return spans.pseudonymised(messages(spark, sf))


@query("str24_restore", f"WITH {SHORT} SELECT conv_id, turn, text AS restored FROM sen")
def _(spark, sf):
    put = spans.pseudonymised(sentences(spark, sf))
    found = sentences(spark, sf).select("conv_id", "turn", "text", spans.without_overlaps(spans.explicit_spans(F.col("text"), P.SESSION_ENTITIES, True), spans.surest_first).alias("s"))
    both = put.join(found, ["conv_id", "turn"])
    # The tokens of a message stand in the order of first use, so the distinct surfaces pair up with them.
    surfaces = F.array_distinct(F.transform("s", lambda s: s["surface"]))
    pairs = F.reverse(F.array_sort(F.transform(F.arrays_zip(F.split("tokens", ",").alias("t"), surfaces.alias("v")), lambda z: F.struct(F.length(z["t"]).alias("l"), z["t"].alias("t"), z["v"].alias("v")))))
    restored = F.aggregate(F.filter(pairs, lambda z: (z["t"] != "") & z["v"].isNotNull()), F.col("pseudonymised"), lambda t, z: F.replace(t, z["t"], z["v"]))
    return both.select("conv_id", "turn", restored.alias("restored"))


@query("plan_analyze")
def _(spark, sf):
    """The whole flow for one message: identifiers, scores, gate, rewrite, second scores, utility, verdict."""
    rows = sentences(spark, sf).select("conv_id", "turn", "text", V.overall_score(F.col("text")).alias("before"), V.identified(F.col("text")).alias("hard"), V.impersonal(F.col("text")).alias("other"))
    rows = rows.withColumn("passed", ((F.col("before") < P.MEDIUM_EDGE) | F.col("other")) & ~F.col("hard"))
    rows = rows.withColumn("asked", F.when(F.col("passed"), F.lit(None)).otherwise(F.col("text")))  # what passes needs no rewrite
    rows = rewriting.with_best(rewriting.with_candidates(rows, "asked"), "asked")
    both = rows.select("conv_id", "turn", "text", "before", F.when(F.col("passed"), "passthrough").otherwise(F.col("engine")).alias("engine"), F.when(F.col("passed"), F.col("text")).otherwise(F.col("rewrite")).alias("served"))
    both = both.withColumns({"after": V.overall_score(F.col("served")), "left": V.identified(F.col("served")).cast("int")})
    both = rewriting.with_counts(both, "pair", F.col("text"), F.array("served")).withColumn("utility", rewriting.utility_of(F.col("pair")))
    delta, verdict = curation.verdict(F.col("before"), F.col("after"), F.col("left"), F.col("utility"))
    return both.select("conv_id", "turn", "engine", "served", "before", "after", "utility", delta.alias("delta"), verdict.alias("verdict"))


@query("stm01_session_leakage", f"WITH {LEAK} SELECT {', '.join(_LEAK_COLUMNS)} FROM leak")
def _(spark, sf):
    """The leakage of win01_05 from a stream of turns, run until the input is read."""
    folder, source, name = shared_folder(spark), shared_folder(spark), f"leakage_{uuid.uuid4().hex[:8]}"
    turn_scores(spark, sf).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *P.ATTRIBUTES).repartition(1 if spark.conf.get("spark.sql.shuffle.partitions") == "1" else 4, "conv_id").write.parquet(source)
    stream = spark.readStream.schema("conv_id long, turn long, " + ", ".join(f"{a} double" for a in P.ATTRIBUTES)).parquet(source)
    q = leakage_stream(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(q_schema()).parquet(f"{folder}/out")


def q_schema() -> str:
    from quillstone.streaming.sessions import OUTPUT

    return OUTPUT


@query("src01_jsonl_round_trip", "SELECT CAST(conv_id AS VARCHAR) AS id, role AS author, count(*) AS n FROM conversations WHERE length(trim(text)) >= 10 GROUP BY ALL")
def _(spark, sf):
    path = shared_folder(spark)
    c = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("author"), "text")
    c.write.json(path)
    rows = files.read_jsonl(spark, path).where(F.length(F.trim("text")) >= 10)
    return rows.groupBy("id", files.author_id().alias("author")).agg(F.count("*").alias("n"))


@query("snk01_split_writer", "SELECT role AS split, count(*) AS n FROM conversations GROUP BY role")
def _(spark, sf):
    path = shared_folder(spark)
    files.write_splits(read(spark, sf, "conversations").withColumn("split", F.col("role")), path)
    return spark.read.json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("flt12_record_errors", """WITH r AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice / 600000 AS score, o_custkey AS owner FROM orders)
    SELECT id, array_to_string(list_filter([CASE WHEN status NOT IN ('F', 'O', 'P') THEN 'status' END, CASE WHEN score < 0 OR score > 1 THEN 'score' END, CASE WHEN owner % 97 = 0 THEN 'owner' END, CASE WHEN status = 'P' AND score > 0.5 THEN 'status:score' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice") / 600000).alias("score"), F.col("o_custkey").alias("owner"))
    rules = {"status": ~F.col("status").isin("F", "O", "P"), "score": (F.col("score") < 0) | (F.col("score") > 1), "owner": F.col("owner") % 97 == 0, "status:score": (F.col("status") == "P") & (F.col("score") > 0.5)}
    return o.select("id", F.array_join(F.array_compact(F.array(*(F.when(c, k) for k, c in rules.items()))), ",").alias("errors"))


@query("flt14_nested_identifiers", f"SELECT count(*) AS n FROM conversations WHERE regexp_matches(text, {quoted(P.EMAIL)})")
def _(spark, sf):
    rows = read(spark, sf, "conversations").select(F.to_json(F.struct(F.struct("text").alias("inner"))).alias("j"))
    return rows.where(T.matches(F.col("j"), P.EMAIL)).agg(F.count("*").alias("n"))


@query("arr13_distribution_scores", """WITH l AS (SELECT o_orderkey AS id, [(o_custkey % 7) / 2.0::DOUBLE, (o_orderkey % 5) / 2.0::DOUBLE, (o_custkey % 3)::DOUBLE, 0.5::DOUBLE] AS z FROM orders),
    e AS (SELECT id, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM l), p AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), r AS (SELECT id, list_sort(p, 'DESC') AS r, -list_sum(list_transform(p, lambda x: x * ln(x))) / ln(4) AS h FROM p)
    SELECT id, round(r[1], 4) AS confidence, round(r[1] - r[2], 4) AS margin, round(h, 4) AS entropy FROM r""")
def _(spark, sf):
    o = read(spark, sf, "orders")
    z = F.array(F.col("o_custkey") % 7 / 2.0, F.col("o_orderkey") % 5 / 2.0, (F.col("o_custkey") % 3).cast("double"), F.lit(0.5))
    e = o.select(F.col("o_orderkey").alias("id"), z.alias("z")).select("id", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    p = e.select("id", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, v: s + v)).alias("p"))
    r = F.sort_array("p", asc=False)
    h = -F.aggregate("p", F.lit(0.0), lambda s, v: s + v * F.log(v)) / F.log(F.lit(4.0))
    return p.select("id", F.round(r[0], 4).alias("confidence"), F.round(r[0] - r[1], 4).alias("margin"), F.round(h, 4).alias("entropy"))


@query("arr14_calibrated", "SELECT o_orderkey AS id, round(1 / (1 + exp(-(1.3 * ((o_custkey % 11) - 5) / 2.0 + 0.2))), 6) AS platt, round(1 / (1 + exp(-(((o_custkey % 11) - 5) / 2.0 / 1.7))), 6) AS tempered FROM orders")
def _(spark, sf):
    z = (F.col("o_custkey") % 11 - 5) / 2.0
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.round(1 / (1 + F.exp(-(1.3 * z + 0.2))), 6).alias("platt"), F.round(1 / (1 + F.exp(-(z / 1.7))), 6).alias("tempered"))


@query("arr02_map_delta", "SELECT o_orderkey AS id, round(o_orderkey % 10 / 10.0 - o_custkey % 7 / 10.0, 4) AS age, round(o_orderkey % 3 / 10.0 - o_custkey % 5 / 10.0, 4) AS location FROM orders")
def _(spark, sf):
    m = lambda a, b: F.create_map(F.lit("age"), a / 10.0, F.lit("location"), b / 10.0)
    before, after = m(F.col("o_orderkey") % 10, F.col("o_orderkey") % 3), m(F.col("o_custkey") % 7, F.col("o_custkey") % 5)
    d = F.map_zip_with(before, after, lambda k, x, y: F.round(x - y, 4))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), d.alias("d")).select("id", F.col("d")["age"].alias("age"), F.col("d")["location"].alias("location"))


@query("stm04_idle_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, sum(new) AS sessions, count(*) AS n FROM g GROUP BY user_id) SELECT user_id, CAST(sessions AS BIGINT) AS sessions, n FROM s""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.lag("ts").over(w)
    new = (last.isNull() | (F.col("ts") > last + F.expr("INTERVAL 1 HOUR"))).cast("int")
    return read(spark, sf, "events").select("user_id", new.alias("new")).groupBy("user_id").agg(F.sum("new").alias("sessions"), F.count("*").alias("n"))


@query("agg39_stage_latency", "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    v = F.col("value")
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.round(F.percentile(v, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(v, F.lit(0.95)), 4).alias("p95"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))


@query("agg35_dense_strata", """WITH d AS (SELECT unnest(['click', 'view', 'signup', 'never']) AS stratum), c AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS k FROM events GROUP BY 1)
    SELECT stratum, coalesce(n, 0) AS n, round(coalesce(k, 0) / greatest(coalesce(n, 0), 1)::DOUBLE, 4) AS rate FROM d LEFT JOIN c ON c.event_type = d.stratum""")
def _(spark, sf):
    strata = spark.createDataFrame([(x,) for x in ("click", "view", "signup", "never")], "stratum string")
    c = read(spark, sf, "events").groupBy(F.col("event_type").alias("stratum")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("k"))
    n = F.coalesce("n", F.lit(0))
    return strata.join(c, "stratum", "left").select("stratum", n.alias("n"), F.round(F.coalesce("k", F.lit(0)) / F.greatest(n, F.lit(1)), 4).alias("rate"))


@query("join10_record_attribute_method", "SELECT a.attribute, m.method, count(*) AS n, CAST(sum(length(t.text)) AS BIGINT) AS chars FROM conversations t, (SELECT unnest(['age', 'location', 'occupation', 'education']) AS attribute) a, (SELECT unnest(['raw', 'redacted', 'rewritten']) AS method) m GROUP BY ALL")
def _(spark, sf):
    rows = read(spark, sf, "conversations").select("text", F.explode(F.array(*map(F.lit, P.ATTRIBUTES))).alias("attribute")).withColumn("method", F.explode(F.array(*map(F.lit, ("raw", "redacted", "rewritten")))))
    return rows.groupBy("attribute", "method").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("join06_dictionary", f"""WITH {MESSAGES}, k AS (SELECT unnest([{', '.join(quoted(c) for c in P.CITIES.lower().split('|'))}]) AS s) SELECT conv_id, turn, s AS surface FROM msg, k WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || s || '([^a-z0-9_]|$)')""")
def _(spark, sf):
    """Dictionary join without a cross join: each text's word runs of the lengths that occur are looked up by equality."""
    names = [c.split(" ") for c in P.CITIES.lower().split("|")]
    bank = spark.createDataFrame([(" ".join(n),) for n in names], "surface string")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    w = messages(spark, sf).select("conv_id", "turn", words.alias("w"))
    longest = 2 * max(map(len, names)) - 1
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.array(*map(F.lit, range(1, longest + 1, 2))), lambda n: F.array_join(F.slice("w", i, n), "")))))
    return w.select("conv_id", "turn", F.explode(runs).alias("surface")).join(F.broadcast(bank), "surface").select("conv_id", "turn", "surface").distinct()
