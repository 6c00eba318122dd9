"""Queries of readers, gates, reports and the remaining seams, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import leakage, metrics, seams
from quillstone.operators import study as S
from quillstone.plans.inputs import MESSAGES, SCORED, SHORT, messages, quoted, read, scored, sentences
from quillstone.plans.privacy_queries import _ATTACK, _SCORES, LOW, _rx, _sql_chain, _sql_scores
from quillstone.plans.study_queries import STUDY, records
from quillstone.sources import files
from quillstone.sources.tables import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# -- sources -----------------------------------------------------------------------------------------------------

@query("src03_json_array_file", "SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def _(spark, sf):
    """One file that holds an array of objects."""
    path = shared_folder(spark)
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))))
    read(spark, sf, "nation").agg(rows.alias("value")).write.text(path)  # a dimension of 25 rows
    schema = files.T.StructType([files.T.StructField("n_nationkey", files.T.IntegerType()), files.T.StructField("n_regionkey", files.T.IntegerType())])
    return files.read_json_file(spark, path, schema).groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))


@query("src04_directory", "SELECT role, count(*) AS n, true AS from_json FROM conversations GROUP BY role")
def _(spark, sf):
    path = shared_folder(spark)
    read(spark, sf, "conversations").select("conv_id", "role").write.json(path)
    read(spark, sf, "region").write.csv(f"{path}/other")
    schema = files.T.StructType([files.T.StructField("conv_id", files.T.LongType()), files.T.StructField("role", files.T.StringType())])
    return files.read_directory(spark, path, schema).groupBy("role").agg(F.count("*").alias("n"), F.bool_and(F.endswith("source_file", F.lit(".json"))).alias("from_json"))


@query("src05_bad_lines", "SELECT CASE WHEN conv_id % 7 = 0 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, sf):
    """Lines that are no JSON stay beside the good ones, with the file they are from."""
    path = shared_folder(spark)
    line = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit('{"id": "'), F.col("turn"))).otherwise(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"))))
    read(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    rows = files.read_jsonl(spark, path).select("id", "_corrupt")
    return rows.groupBy(F.when(F.col("_corrupt").isNotNull() | F.col("id").isNull(), "bad").otherwise("good").alias("kind")).agg(F.count("*").alias("n"))


@query("src08_usage_csv", "SELECT event_type AS kind, count(*) AS n, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS with_note FROM events GROUP BY 1")
def _(spark, sf):
    """A log with short rows: declared columns that a row lacks are null."""
    path = shared_folder(spark)
    e = read(spark, sf, "events")
    row = F.when(F.col("event_id") % 2 == 0, F.concat_ws(",", "event_id", "event_type", F.lit("note"))).otherwise(F.concat_ws(",", "event_id", "event_type"))
    e.select(row.alias("value")).write.text(path)
    rows = spark.read.schema("id string, kind string, note string").option("header", False).csv(path)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("note").alias("with_note"))


@query("src09_split_ids", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 < 7) GROUP BY 1")
def _(spark, sf):
    """Ids of a split, read from a file, keep the records of that split."""
    path = shared_folder(spark)
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 < 7, "train").otherwise("rest").alias("split"))
    c.write.json(path)
    train = spark.read.schema("id long, split string").json(path).where("split = 'train'").select(F.col("id").alias("o_custkey"))
    return read(spark, sf, "orders").join(train, "o_custkey", "left_semi").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("src10_verified_members", "SELECT count(*) AS n, 0::BIGINT AS foreign_rows FROM nation")
def _(spark, sf):
    """A file whose digest is that of its manifest, and the rows whose key is not among the known ones: there are none."""
    path = shared_folder(spark)
    read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("text")).coalesce(1).write.json(path)
    manifest = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", F.sha2("content", 256).alias("d")).first()
    rows = files.verified(spark, manifest["path"], manifest["d"]).select("id")
    known = read(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    foreign = rows.join(known, "id", "left_anti").agg(F.count("*").alias("foreign_rows"))
    return rows.agg(F.count("*").alias("n")).crossJoin(foreign)  # one row each


@query("src13_flat_records", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(max(length(t)) AS INTEGER) AS longest FROM (SELECT conv_id, substr(coalesce(text, ''), 1, 2000) AS t FROM conversations) GROUP BY conv_id")
def _(spark, sf):
    rows = read(spark, sf, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"), F.struct("turn", "role").alias("meta"))
    flat = files.flat_records(rows).where(F.startswith("meta", F.lit('{"turn":')))
    return flat.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("src02_first_source", "SELECT count(*) AS n FROM region")
def _(spark, sf):
    return spark.read.parquet(files.first_source(spark, f"{sf}/not-here.parquet", f"{sf}/region.parquet")).agg(F.count("*").alias("n"))


@query("src11_bank_table", "SELECT surface, 'location' AS attribute FROM (SELECT unnest([" + ", ".join(quoted(c.lower()) for c in P.CITIES.split("|")) + "]) AS surface)")
def _(spark, sf):
    """A bank as a dimension table of surfaces."""
    from quillstone.plans.extra_queries import bank

    return spark.createDataFrame([(s, a) for s, (a, _) in bank().surfaces.items() if a == "location"], "surface string, attribute string")


@query("snk05_append_whole", "SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path = shared_folder(spark)
    e = read(spark, sf, "events").select("event_type")
    files.append_whole(e, path)
    files.append_whole(e, path)
    return spark.read.schema("event_type string").json(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("snk06_matrix", f"WITH {STUDY}, g AS (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE would_use) AS y FROM study GROUP BY scenario) SELECT '| scenario | records | would use |' || chr(10) || '|-|-|-|' || chr(10) || string_agg('| ' || scenario || ' | ' || n || ' | ' || y || ' |', chr(10) ORDER BY scenario) AS matrix FROM g")
def _(spark, sf):
    """A Markdown table of an aggregate of a few rows."""
    g = records(spark, sf).groupBy("scenario").agg(F.count("*").alias("n"), F.count_if("would_use").alias("y"))
    line = F.concat(F.lit("| "), "scenario", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("y").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scenario", line.alias("l")))), lambda x: x["l"]), "\n")
    return g.agg(F.concat(F.lit("| scenario | records | would use |\n|-|-|-|\n"), lines).alias("matrix"))


# -- predicates and gates ----------------------------------------------------------------------------------------

@query("flt03_low_risk_pool", f"WITH {_SCORES} SELECT CASE WHEN greatest(age, location, occupation, education) < 0.25 THEN 'identity' ELSE 'rewrite' END AS pool, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    overall = F.greatest(*V.rule_scores(F.col("text")).values())
    return messages(spark, sf).groupBy(F.when(overall < 0.25, "identity").otherwise("rewrite").alias("pool")).agg(F.count("*").alias("n"))


@query("flt04_inferable", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS age, CASE WHEN o_custkey % 3 = 1 THEN 0.0 ELSE 0.0 END::DOUBLE AS location FROM orders")
def _(spark, sf):
    """Labels from nested reviews: a human estimate that is not blank."""
    k = F.col("o_custkey") % 3
    part = lambda name, text: F.struct(F.lit(name).alias("key"), F.struct(text.alias("estimate")).alias("value"))
    human = F.map_from_entries(F.array(part("age", F.when(k == 0, "31").when(k == 1, "  ")), part("location", F.when(k == 1, " "))))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct(human.alias("human")).alias("reviews"))
    return rows.select("id", files.inferable("age").alias("age"), files.inferable("location").alias("location"))


_DISCLOSES = f"NOT contains(text, '?') AND NOT {_rx('text', '(?i)' + P.DISCLOSURE_VETO)} AND ({' OR '.join(_rx('text', '(?i)' + p) for p in P.DISCLOSURE)})"


@query("flt11_disclosure", f"WITH {SHORT} SELECT conv_id, turn, {_DISCLOSES} AS discloses FROM (SELECT conv_id, turn, regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g') AS text FROM sen)")
def _(spark, sf):
    t = F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x")
    says = F.lit(False)
    for p in P.DISCLOSURE:
        says = says | T.matches(t, p, ignore_case=True)
    discloses = ~F.contains(t, F.lit("?")) & ~T.matches(t, P.DISCLOSURE_VETO, ignore_case=True) & says
    return sentences(spark, sf).select("conv_id", "turn", discloses.alias("discloses"))


# The held-out model, which must not make training data.
HELD_OUT = ("phi-4",)


@query("flt19_denied_teachers", "SELECT m AS model, count(*) AS n FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'Phi-4-mini' WHEN 1 THEN 'small-instruct' ELSE 'rules' END AS m FROM orders) WHERE NOT contains(lower(m), 'phi-4') GROUP BY m")
def _(spark, sf):
    m = F.when(F.col("o_orderkey") % 3 == 0, "Phi-4-mini").when(F.col("o_orderkey") % 3 == 1, "small-instruct").otherwise("rules")
    denied = F.exists(F.array(*map(F.lit, HELD_OUT)), lambda h: F.contains(F.lower("model"), h))
    return read(spark, sf, "orders").select(m.alias("model")).where(~denied).groupBy("model").agg(F.count("*").alias("n"))


@query("join13_reconciled", "WITH a AS (SELECT n_nationkey AS k, n_regionkey AS v FROM nation WHERE n_nationkey % 6 > 0), b AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 9 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey % 7 > 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN b ON a.k = b.k")
def _(spark, sf):
    """Manifest against runtime: what is missing, extra or changed."""
    n = read(spark, sf, "nation")
    a = n.where("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("a"), F.lit(True).alias("in_a"))
    b = n.where("n_nationkey % 7 > 0").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 5 == 0, 9).otherwise(F.col("n_regionkey")).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "extra").when(F.col("in_b").isNull(), "missing").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query("agg38_release_gate", "WITH c AS (SELECT n_regionkey AS artifact, count(*) AS files, count(*) FILTER (WHERE n_nationkey % 5 = 0) AS changed FROM nation GROUP BY 1) SELECT artifact, CASE WHEN changed > 0 THEN 'BLOCKED' ELSE 'READY' END AS gate, files, changed FROM c")
def _(spark, sf):
    """A release is ready if the digest of every file is that of its manifest."""
    n = read(spark, sf, "nation").select("n_regionkey", F.sha2("n_name", 256).alias("listed"), F.sha2(F.when(F.col("n_nationkey") % 5 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")), 256).alias("found"))
    c = n.groupBy(F.col("n_regionkey").alias("artifact")).agg(F.count("*").alias("files"), F.count_if(F.col("listed") != F.col("found")).alias("changed"))
    return c.select("artifact", F.when(F.col("changed") > 0, "BLOCKED").otherwise("READY").alias("gate"), "files", "changed")


@query("agg40_decision_gate", f"""WITH {SCORED}, t AS (SELECT attribute, sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS called, sum(y) AS pos, sum(CASE WHEN p >= 0.4 AND y = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp2, sum(CASE WHEN p >= 0.4 THEN 1 ELSE 0 END) AS called2 FROM scored GROUP BY attribute),
    f AS (SELECT attribute, 2 * tp / (called + pos) AS old, 2 * tp2 / (called2 + pos) AS new FROM t) SELECT attribute, round(new - old, 6) AS gain, CASE WHEN new - old > 0.015 THEN 'adopt' WHEN new - old < -0.015 THEN 'keep' ELSE 'tie' END AS decision FROM f""")
def _(spark, sf):
    """A change is adopted if F1 rises by more than .015, refused if it falls by more, else it is a tie."""
    old = metrics.at_threshold(scored(spark, sf), 0.5).select("attribute", F.col("f1").alias("old"))
    new = metrics.at_threshold(scored(spark, sf), 0.4).select("attribute", F.col("f1").alias("new"))
    gain = F.col("new") - F.col("old")
    return old.join(new, "attribute").select("attribute", F.round(gain, 6).alias("gain"), F.when(gain > 0.015, "adopt").when(gain < -0.015, "keep").otherwise("tie").alias("decision"))


@query("aux05_macro_metrics", f"""WITH {SCORED}, n AS (SELECT attribute, count(*) FILTER (WHERE p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM scored GROUP BY attribute),
    h AS (SELECT attribute, 2 * tp / (2 * tp + fp + fn) AS f1, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM n) SELECT attribute, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM h UNION ALL SELECT 'macro', round(avg(f1), 6), round(avg(precision), 6), round(avg(recall), 6) FROM h""")
def _(spark, sf):
    h = metrics.at_threshold(scored(spark, sf)).select("attribute", "f1", "precision", "recall")
    names = ("f1", "precision", "recall")
    both = h.unionByName(h.groupBy(F.lit("macro").alias("attribute")).agg(*(F.avg(c).alias(c) for c in names)))
    return both.select("attribute", *(F.round(c, 6).alias(c) for c in names))


# -- reports and conversations -----------------------------------------------------------------------------------

_DIST = " UNION ALL ".join(f"SELECT conv_id, turn, '{a}' AS attribute, x AS label, CASE WHEN {a} = 'UNKNOWN' THEN 1.0 / {len(ls)} WHEN {a} = x THEN 0.6 ELSE 0.4 / {len(ls) - 1} END::DOUBLE AS p FROM att, (SELECT unnest([{', '.join(map(quoted, ls))}]) AS x)" for a, ls in P.TAXONOMY.items())


@query("win09b_turn_distributions", f"WITH {MESSAGES}, att AS (SELECT conv_id, turn, {_ATTACK} FROM msg) SELECT conv_id, turn, attribute, label, round(p, 6) AS p FROM ({_DIST})")
def _(spark, sf):
    labels = messages(spark, sf).select("conv_id", "turn", *(c.alias(a) for a, c in V.attack_labels(F.col("text")).items()))
    return leakage.turn_distributions(labels).select("conv_id", "turn", "attribute", "label", F.round("p", 6).alias("p"))


@query("win09c_report_order", f"WITH {_SCORES}, l AS (SELECT conv_id, turn, unnest(['age', 'location', 'occupation', 'education']) AS a, unnest([age, location, occupation, education]) AS v, unnest([0, 1, 2, 3]) AS i FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY v DESC, i) AS k FROM l) SELECT conv_id, turn, max(a) FILTER (WHERE k = 1) AS primary_attribute, coalesce(string_agg(a, ',' ORDER BY k) FILTER (WHERE k > 1 AND v >= 0.3), '') AS secondary FROM r GROUP BY conv_id, turn")
def _(spark, sf):
    """Attributes by falling risk, equals in their fixed order: the first is primary, others of medium risk or more are secondary."""
    entries = F.array(*(F.struct((-s).alias("o"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, (a, s) in enumerate(V.rule_scores(F.col("text")).items())))
    rows = messages(spark, sf).select("conv_id", "turn", F.array_sort(entries).alias("e"))
    rest = F.filter(F.slice("e", 2, 3), lambda x: -x["o"] >= P.MEDIUM_EDGE)
    return rows.select("conv_id", "turn", F.col("e")[0]["a"].alias("primary_attribute"), F.array_join(F.transform(rest, lambda x: x["a"]), ",").alias("secondary"))


@query("top04_best_of_six", "WITH c AS (SELECT l_orderkey AS id, l_linenumber AS k, (l_partkey % 100) / 100.0::DOUBLE AS importance FROM lineitem WHERE l_linenumber <= 6) SELECT id, k, importance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY importance DESC, k) AS r FROM c WHERE importance >= 0.15) WHERE r <= 3")
def _(spark, sf):
    """Of up to six candidates of a key the three best that reach the floor."""
    c = read(spark, sf, "lineitem").where("l_linenumber <= 6").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 100 / 100.0).alias("importance")).where("importance >= 0.15")
    best = c.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "k"))), 1, 3).alias("b"))
    return best.select("id", F.explode("b").alias("x")).select("id", "x.k", (-F.col("x.o")).alias("importance"))


_PROTECTED = f"WITH {MESSAGES}, a AS (SELECT conv_id, turn, greatest(age, location, occupation, education) AS p FROM (SELECT conv_id, turn, {_sql_scores()} FROM (SELECT *, {LOW} AS low FROM msg))), q AS (SELECT conv_id, turn, greatest(age, location, occupation, education) AS q FROM (SELECT conv_id, turn, {_sql_scores()} FROM (SELECT conv_id, turn, {LOW} AS low FROM (SELECT conv_id, turn, {_sql_chain('text', P.PLACEHOLDERS)} AS text FROM msg))))"


@query("stm03_peek_and_commit", f"{_PROTECTED} SELECT conv_id, turn, round(1 - coalesce(product(1 - q) OVER w, 1) * (1 - p), 6) AS peek, round(1 - coalesce(product(1 - q) OVER w, 1) * (1 - q), 6) AS committed FROM a JOIN q USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, sf):
    """Leakage of a conversation if a turn were sent as it is (a look that leaves no trace), and as its protected text (which
    counts from then on)."""
    overall = lambda c: F.greatest(*V.rule_scores(c).values())
    rows = messages(spark, sf).select("conv_id", "turn", "text").withColumn("safe", V.placeholders(F.col("text"))).select("conv_id", "turn", overall(F.col("text")).alias("p"), overall(F.col("safe")).alias("q"))
    before = F.coalesce(F.product(1 - F.col("q")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return rows.select("conv_id", "turn", F.round(1 - before * (1 - F.col("p")), 6).alias("peek"), F.round(1 - before * (1 - F.col("q")), 6).alias("committed"))


# -- seams -------------------------------------------------------------------------------------------------------

@query("udf01_risk_model", f"WITH {MESSAGES} SELECT conv_id, turn, CAST(length(text) % 10 / 10.0 AS DOUBLE) AS age, CAST(length(text) % 7 / 10.0 AS DOUBLE) AS location FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM msg)")
def _(spark, sf):
    """A risk model is a function of texts that gives a score for each attribute."""

    model = seams.risk_model(lambda: lambda texts: [{"age": len(t) % 10 / 10, "location": len(t) % 7 / 10} for t in texts])
    plain = F.regexp_replace("text", "[^ -~]", "x")
    return messages(spark, sf).select("conv_id", "turn", model(plain).alias("m")).select("conv_id", "turn", "m.age", "m.location")


@query("udf03_candidate_model", f"WITH {MESSAGES} SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest([lower(text), upper(text)]) AS candidate FROM (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM msg)")
def _(spark, sf):
    """A generator of candidates is a function of texts that gives some for each."""
    model = seams.candidate_model(lambda: lambda texts: [[t.lower(), t.upper()] for t in texts])
    return messages(spark, sf).select("conv_id", "turn", F.posexplode(model(F.regexp_replace("text", "[^ -~]", "x"))).alias("pos", "candidate"))


@query("udf06_new_values", f"WITH {SHORT}, v AS (SELECT conv_id, turn, unnest([{', '.join(quoted(c) for c in P.CITIES.split('|'))}]) AS x, text, other FROM sen) SELECT conv_id, turn, x AS added FROM v WHERE contains(other, x) AND NOT contains(text, x)")
def _(spark, sf):
    """Surfaces that a scanner finds in a rewrite and that its original does not hold."""
    cities = P.CITIES.split("|")
    scanner = seams.value_scanner(lambda: lambda texts: [[c for c in cities if c in t] for t in texts])
    return sentences(spark, sf).select("conv_id", "turn", F.explode(scanner(F.col("text"), F.col("other"))).alias("added"))


@query("udf08_adversary", f"WITH {MESSAGES}, c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM msg GROUP BY conv_id) SELECT conv_id, {_ATTACK}, 'heuristic' AS mode FROM c")
def _(spark, sf):
    """What an adversary infers from all messages of a conversation, and by which mode it did."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = messages(spark, sf).groupBy("conv_id").agg(whole.alias("text"))
    return rows.select("conv_id", *(c.alias(a) for a, c in V.attack_labels(F.col("text")).items()), F.lit("heuristic").alias("mode"))
