"""Smaller operators of the survey, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import curation, splits
from quillstone.plans.inputs import SHORT, pick, quoted, read, sentences, sql_pick
from quillstone.plans.privacy_queries import _C1, _C2, _DEG, _F, _PAIR

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("str03_contains_run", f"WITH {_PAIR} SELECT conv_id, turn, contains(' ' || array_to_string(ta, ' ') || ' ', ' ' || array_to_string(tb[1:2], ' ') || ' ') AS has FROM pair")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", T.contains_run(T.tokens(F.col("text")), F.slice(T.tokens(F.col("other")), 1, 2)).alias("has"))


@query("str28_cosine_equal_empty", f"WITH {_PAIR} SELECT conv_id, turn, round(CASE WHEN len(ta) = 0 AND len(tb) = 0 THEN 1.0 ELSE cosine END, 6) AS cosine FROM pair")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", F.round(T.token_cosine(F.col("text"), F.col("other"), equal_empty=True), 6).alias("cosine"))


@query("str31_entailment_c", f"WITH {_PAIR} SELECT conv_id, turn, round(greatest(0.5, cosine), 6) AS entailment, round(0.1 * (1 - cosine), 6) AS contradiction, round(sqrt(greatest(0.5, cosine) * greatest(0.5, cosine)), 6) AS both_ways FROM pair")
def _(spark, sf):
    rows = sentences(spark, sf).select("conv_id", "turn", T.token_cosine(F.col("text"), F.col("other")).alias("s"))
    e = F.greatest(F.lit(0.5), F.col("s"))
    return rows.select("conv_id", "turn", F.round(e, 6).alias("entailment"), F.round(0.1 * (1 - F.col("s")), 6).alias("contradiction"), F.round(F.sqrt(e * e), 6).alias("both_ways"))


_ANSWERS = ("<prediction>Denver, CO</prediction>", "Answer: *nurse*", "I would say 34", "no idea", "<reasoning>x</reasoning><PREDICTION> 30s </PREDICTION>", "Inferred: Boston")


@query("str35_answers", f"""WITH a AS (SELECT o_orderkey AS id, {sql_pick(_ANSWERS, 'o_orderkey')} AS t FROM orders)
    SELECT id, CASE WHEN regexp_matches(t, '(?is)<prediction>(.*?)</prediction>') THEN trim(regexp_extract(t, '(?is)<prediction>(.*?)</prediction>', 1))
        WHEN regexp_matches(t, '(?i)(?:prediction|infer|inferred|answer):\\s*(.+)') THEN regexp_replace(trim(regexp_extract(t, '(?i)(?:prediction|infer|inferred|answer):\\s*(.+)', 1)), '[*`]', '', 'g')
        WHEN regexp_matches(lower(t), '\\b(\\d{{1,2}}(?:\\s*-\\s*\\d{{1,2}})?|\\d0s)\\b') THEN regexp_extract(lower(t), '\\b(\\d{{1,2}}(?:\\s*-\\s*\\d{{1,2}})?|\\d0s)\\b') ELSE 'unknown' END AS age FROM a""")
def _(spark, sf):
    """Age answers: tagged, else after a label, else the first number; else unknown."""
    t = pick(_ANSWERS, F.col("o_orderkey"))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), t.alias("t"))
    tagged, labelled, number = r"(?is)<prediction>(.*?)</prediction>", r"(?i)(?:prediction|infer|inferred|answer):\s*(.+)", r"\b(\d{1,2}(?:\s*-\s*\d{1,2})?|\d0s)\b"
    t = F.col("t")
    answer = F.when(t.rlike(tagged), F.trim(F.regexp_extract(t, tagged, 1))).when(t.rlike(labelled), F.regexp_replace(F.trim(F.regexp_extract(t, labelled, 1)), "[*`]", ""))
    return rows.select("id", answer.when(F.lower(t).rlike(number), F.regexp_extract(F.lower(t), number, 0)).otherwise("unknown").alias("age"))


_OFFICES = ("Zurich, Switzerland", "the / a", "NY; 42", "software engineer", "at", "")
_GENERIC = ("the", "a", "an", "in", "of", "and", "or", "at", "on", "to", "for", "with", "no", "not", "none", "unknown")


@query("str40_sensitive_runs", f"""WITH a AS (SELECT o_orderkey AS id, unnest(regexp_split_to_array({sql_pick(_OFFICES, 'o_orderkey')}, '[,/;]')) AS part FROM orders), t AS (SELECT id, regexp_extract_all(lower(part), '[a-z0-9]+') AS w FROM a)
    SELECT id, coalesce(string_agg(DISTINCT array_to_string(w, ' '), '|' ORDER BY array_to_string(w, ' ')) FILTER (WHERE len(list_filter(w, lambda x: NOT list_contains([{', '.join(map(quoted, _GENERIC))}], x))) > 0 AND (length(array_to_string(w, '')) >= 3 OR regexp_matches(array_to_string(w, ''), '^[0-9]+$'))), '') AS runs FROM t GROUP BY id""")
def _(spark, sf):
    parts = F.transform(F.split(pick(_OFFICES, F.col("o_orderkey")), "[,/;]"), T.alnum_tokens)
    plain = F.array(*map(F.lit, _GENERIC))
    tells = lambda w: (F.size(F.array_except(w, plain)) > 0) & ((F.length(F.array_join(w, "")) >= 3) | F.array_join(w, "").rlike("^[0-9]+$"))
    runs = F.array_sort(F.array_distinct(F.transform(F.filter(parts, tells), lambda w: F.array_join(w, " "))))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(runs, "|").alias("runs"))


@query("str44_repair", f"WITH {SHORT} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(replace(text, '.', ' .  '), '\\s{{2,}}', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g')) AS repaired FROM sen")
def _(spark, sf):
    t = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("."), F.lit(" .  ")), r"\s{2,}", " "), r"\s+([,.;:!?])", "$1")
    return sentences(spark, sf).select("conv_id", "turn", F.trim(t).alias("repaired"))


@query("flt18_first_change", f"""WITH {_PAIR}, z AS (SELECT conv_id, turn, ta, list_position(list_transform(range(1, len(ta) + 1), lambda i: ta[i] IS DISTINCT FROM tb[i]), true) AS k FROM pair)
    SELECT conv_id, turn, CASE WHEN k IS NULL OR k = 0 THEN 'none' WHEN (k - 1) / len(ta)::DOUBLE < 0.34 THEN 'start' WHEN (k - 1) / len(ta)::DOUBLE < 0.67 THEN 'middle' ELSE 'end' END AS place FROM z""")
def _(spark, sf):
    rows = sentences(spark, sf).select("conv_id", "turn", T.tokens(F.col("text")).alias("a"), T.tokens(F.col("other")).alias("b"))
    k = F.array_position(F.transform("a", lambda x, i: ~x.eqNullSafe(F.get("b", i))), F.lit(True))
    share = (k - 1) / F.size("a")
    return rows.select("conv_id", "turn", F.when(k == 0, "none").when(share < 0.34, "start").when(share < 0.67, "middle").otherwise("end").alias("place"))


_CITY = ("Paris, France", " , Spain", "Oslo", "", "Austin, Texas, US")


@query("flt08_report_buckets", f"""WITH a AS (SELECT o_orderkey AS id, 10 + o_custkey % 90 AS age, {sql_pick(_CITY, 'o_custkey')} AS c FROM orders)
    SELECT id, CASE WHEN age BETWEEN 18 AND 24 THEN '18-24' WHEN age BETWEEN 25 AND 34 THEN '25-34' WHEN age BETWEEN 35 AND 44 THEN '35-44' WHEN age BETWEEN 45 AND 54 THEN '45-54' WHEN age BETWEEN 55 AND 200 THEN '55+' END AS bucket,
        list_filter(list_transform(string_split(c, ','), lambda x: trim(x)), lambda x: x <> '')[-1] AS country FROM a""")
def _(spark, sf):
    age = 10 + F.col("o_custkey") % 90
    parts = F.filter(F.transform(F.split(pick(_CITY, F.col("o_custkey")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(age.between(18, 200), V.age_label(age)).alias("bucket"), F.try_element_at(parts, F.lit(-1)).alias("country"))


_EDUCATION = ("PhD in Law", "a Ph.D. student", "Masters in Business", "MBA", "mastered the lute", "Bachelor of Arts", "B.A. in music", "some college", "High School", "", "welding course", "BA")
_LEVELS = "CASE WHEN e = '' THEN NULL " + " ".join(f"WHEN regexp_matches(e, {quoted('(?i)' + p)}) THEN '{level}'" for level, p in P.EDUCATION_LEVELS) + " ELSE 'high_school' END"


@query("flt08_education_levels", f"WITH a AS (SELECT o_orderkey AS id, {sql_pick(_EDUCATION, 'o_custkey')} AS e FROM orders) SELECT id, e AS education, {_LEVELS} AS level FROM a")
def _(spark, sf):
    e = pick(_EDUCATION, F.col("o_custkey"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), e.alias("education"), V.education_level(e).alias("level"))


@query("join08_age_overlap", "SELECT o_orderkey AS id, greatest(o_custkey % 50, o_orderkey % 60) <= least(o_custkey % 50 + 9, o_orderkey % 60 + 4) AS overlap FROM orders")
def _(spark, sf):
    a, b = F.col("o_custkey") % 50, F.col("o_orderkey") % 60
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.greatest(a, b) <= F.least(a + 9, b + 4)).alias("overlap"))


@query("prj01_key_fallback", "SELECT o_orderkey AS row_key, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), nullif(o_orderpriority, '')) AS profile_id FROM orders")
def _(spark, sf):
    blank = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"), F.coalesce(F.nullif(blank, F.lit("")), F.nullif("o_orderpriority", F.lit(""))).alias("profile_id"))


@query("agg14_published_accuracy", """WITH e AS (SELECT o_orderpriority AS feature, [(o_orderkey % 3) / 2.0, (o_custkey % 2)::DOUBLE, (o_custkey % 3) / 2.0] AS e FROM orders)
    SELECT feature, round(avg(CASE WHEN e[1] = 1 THEN 1.0 ELSE 0.0 END), 6) AS strict, round(avg(CASE WHEN e[1] >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS lenient, round(avg(CASE WHEN list_contains(e[1:3], 1) THEN 1.0 ELSE 0.0 END), 6) AS top3 FROM e GROUP BY feature""")
def _(spark, sf):
    e = F.array(F.col("o_orderkey") % 3 / 2.0, (F.col("o_custkey") % 2).cast("double"), F.col("o_custkey") % 3 / 2.0)
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("feature"), e.alias("e"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("feature").agg(share(F.col("e")[0] == 1).alias("strict"), share(F.col("e")[0] >= 0.5).alias("lenient"), share(F.exists(F.slice("e", 1, 3), lambda x: x == 1)).alias("top3"))


@query("smp02_plain_split", "WITH k AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey) AS k FROM customer) SELECT id, CASE WHEN k <= 210 THEN 'train' WHEN k <= 255 THEN 'val' ELSE 'test' END AS split FROM k WHERE k <= 300")
def _(spark, sf):
    """210 / 45 / 45: the first 300 of the seeded order, a bounded set, are numbered."""
    first = splits.seeded_sample(read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), "id", 300, 42)
    k = F.row_number().over(Window.orderBy(splits.seeded_key("id", 42), "id"))
    return first.select("id", F.when(k <= 210, "train").when(k <= 255, "val").otherwise("test").alias("split"))


@query("agg32_corpus_distributions", f"WITH {SHORT}, a AS (SELECT conv_id % 3 AS position, unnest(['age', 'location'][1:CAST(turn % 3 AS INTEGER)]) AS attribute FROM sen) SELECT position, attribute, count(*) AS n FROM a GROUP BY ALL")
def _(spark, sf):
    some = F.slice(F.array(F.lit("age"), F.lit("location")), F.lit(1), (F.col("turn") % 3).cast("int"))
    return sentences(spark, sf).select((F.col("conv_id") % 3).alias("position"), F.explode(some).alias("attribute")).groupBy("position", "attribute").agg(F.count("*").alias("n"))


@query("set03_05_set_tests", f"WITH {_PAIR} SELECT conv_id, turn, len(list_filter(sa, lambda x: NOT list_contains(sb, x))) = 0 AS subset, len(list_intersect(sa, sb)) AS shared, len(list_distinct(list_concat(sa, sb))) AS together FROM pair")
def _(spark, sf):
    rows = sentences(spark, sf).select("conv_id", "turn", F.array_distinct(T.tokens(F.col("text"))).alias("a"), F.array_distinct(T.tokens(F.col("other"))).alias("b"))
    long = lambda c: F.size(c).cast("long")
    return rows.select("conv_id", "turn", (F.size(F.array_except("a", "b")) == 0).alias("subset"), long(F.array_intersect("a", "b")).alias("shared"), long(F.array_union("a", "b")).alias("together"))


@query("aux12_failure_labels", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN o_orderstatus ELSE array_to_string(list_filter([o_orderstatus, CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END], lambda x: x IS NOT NULL), '|') END AS labels FROM orders")
def _(spark, sf):
    both = F.array_compact(F.array("o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority"))))
    k = F.col("o_orderkey") % 4
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "").when(k == 1, F.col("o_orderstatus")).otherwise(F.array_join(both, "|")).alias("labels"))


@query("arr12_bands", "SELECT o_orderkey AS id, CASE WHEN (o_custkey % 101) / 100.0 >= 0.60 THEN 'HIGH' WHEN (o_custkey % 101) / 100.0 >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM orders")
def _(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), V.band(F.col("o_custkey") % 101 / 100.0).alias("band"))




_RUN = ("denver", "software engineer", "alice smith")


@query("str41_judged", f"""WITH {_PAIR}, z AS (SELECT pair.*, text, other, {_DEG} AS deg, {_F} AS f, greatest({_C1}, {_C2}) AS c, ' ' || array_to_string(regexp_extract_all(lower(other), '[a-z0-9]+'), ' ') || ' ' AS w FROM pair JOIN sen USING (conv_id, turn))
    SELECT conv_id, turn, CASE WHEN trim(other) = '' THEN 'empty' WHEN text = other THEN 'unchanged' WHEN deg IS NOT NULL THEN 'degenerate:' || deg WHEN {' OR '.join(f"contains(w, ' {r} ')" for r in _RUN)} THEN 'leak'
        WHEN c > 0.2 THEN 'contradiction' WHEN f < 0.5 AND cosine < 0.5 THEN 'drifted' END AS reason FROM z""")
def _(spark, sf):
    runs = F.array(*(F.array(*map(F.lit, r.split(" "))) for r in _RUN))
    return curation.judged(sentences(spark, sf).withColumn("runs", runs), "text", "other", "runs").select("conv_id", "turn", "reason")


_HEAD = "trim(regexp_split_to_array(t, ',\\s*(?:and\\s+|can\\s+|could\\s+|please\\s+|help\\s+)?')[1])"
_CLOSE = "CASE WHEN contains(t, '?') THEN '?' ELSE '.' END"


@query("str43_negatives", f"""WITH {SHORT}, a AS (SELECT conv_id, turn, trim(text) AS s, trim(other) AS t, upper({sql_pick(P.ATTRIBUTES, 'conv_id')}) AS att FROM sen), b AS (SELECT *, {_HEAD} AS h, list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '') AS w FROM a),
    c AS (SELECT *, CASE WHEN regexp_matches(h, '[?.]$') THEN h ELSE h || {_CLOSE} END AS cl, len(list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '')) AS hn, regexp_replace(t, '\\bmy (?:work|role|area|studies)\\b', '[' || att || ']', 'g') AS tg FROM b),
    n AS (SELECT conv_id, turn, t, 'truncation_over_scrub' AS kind, CASE WHEN h <> t AND hn >= 4 AND cl <> t THEN cl WHEN len(w) >= 12 THEN array_to_string(w[1:len(w) // 2], ' ') || {_CLOSE} END AS text FROM c
        UNION ALL SELECT conv_id, turn, t, 'pii_leak_under_scrub', s FROM c UNION ALL SELECT conv_id, turn, t, 'syntax_placeholder_degenerate', CASE WHEN trim(tg) <> t THEN trim(tg) ELSE '[' || att || ']: ' || t END FROM c)
    SELECT conv_id, turn, kind, text FROM n WHERE text IS NOT NULL AND text <> t""")
def _(spark, sf):
    rows = sentences(spark, sf).select("conv_id", "turn", F.explode(curation.negatives(F.col("other"), F.col("text"), pick(P.ATTRIBUTES, F.col("conv_id")))).alias("n"))
    return rows.select("conv_id", "turn", "n.kind", "n.text")
