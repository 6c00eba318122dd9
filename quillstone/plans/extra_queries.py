"""Queries of the operators in `reporting`, of banks, sinks and session stores, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import banks, rewriting, spans
from quillstone.operators import answers as A
from quillstone.operators import cues as C
from quillstone.operators import reporting as R
from quillstone.plans.inputs import MESSAGES, SHORT, messages, quoted, read, sentences, spread
from quillstone.plans.privacy_queries import _DEG, _PAIR, LOW, PLAIN, _rx, _sql_cascade, _sql_chain, _sql_scores, _sub
from quillstone.plans.study_queries import STUDY, records
from quillstone.sources.banks import Bank
from quillstone.sources.tables import shared_folder
from quillstone.sources.vault import Vault

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


# -- scores and cues ---------------------------------------------------------------------------------------------

_KEYWORDS = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(text), {quoted(w)})' for w in ws)} THEN {s}::DOUBLE ELSE 0.1::DOUBLE END AS {a}" for a, (s, ws) in R.KEYWORD_SCORES.items())


@query("str11_keyword_scores", f"WITH {MESSAGES} SELECT conv_id, turn, {_KEYWORDS} FROM msg")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", *(s.alias(a) for a, s in R.keyword_scores(F.col("text")).items()))


_NO_ACCENTS = PLAIN.replace("'x'", "'1'")  # a word character, but no letter, as RE2 sees it
_RULES = [(a, i, p) for i, (a, ps) in enumerate(P.PRESENCE_CUES.items()) for p in ps]


@query("str13_pattern_cues", f"WITH {MESSAGES}, m AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, {i} AS i, '{a}' AS attribute, lower(trim(unnest(regexp_extract_all({_NO_ACCENTS}, {quoted('(?i)' + p)})))) AS span FROM msg WHERE {' OR '.join(_rx(LOW, c) for c in P.PRESENCE_CUES[a])}" for a, i, p in _RULES) + ") SELECT conv_id, turn, arg_min(attribute, i) AS attribute, span FROM m WHERE length(span) >= 2 GROUP BY conv_id, turn, span")
def _(spark, sf):
    scores = F.create_map(*(x for a, s in V.presence_scores(F.col("text")).items() for x in (F.lit(a), s)))
    cues = C.pattern_cues(F.col("text"), F.col("scores"))
    rows = spread(messages(spark, sf)).withColumn("scores", scores).select("conv_id", "turn", F.explode(cues).alias("c"))
    return rows.select("conv_id", "turn", "c.attribute", F.lower("c.surface").alias("span"))


@query("flt16_person_acronyms", f"WITH {MESSAGES}, n AS (SELECT conv_id, turn, unnest(regexp_extract_all({PLAIN}, '\\b[A-Z][A-Za-z]+\\b')) AS name FROM msg) SELECT name, count(*) AS n FROM n WHERE upper(name) NOT IN ({', '.join(map(quoted, R.ACRONYMS))}) GROUP BY name")
def _(spark, sf):
    names = F.regexp_extract_all(F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x"), F.lit(r"\b[A-Z][A-Za-z]+\b"), F.lit(0))
    return messages(spark, sf).select(F.explode(R.without_acronyms(names)).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("arr05_merged_phrases")
def _(spark, sf):
    """Phrases of each message, from pieces of up to four letters whose salience is their share of capital letters and vowels."""
    rows = spread(messages(spark, sf)).select("conv_id", "turn", "text", _pieces(F.col("text")).alias("p"))
    found = C.phrases(F.col("text"), F.col("p"))
    return rows.select("conv_id", "turn", F.explode(found).alias("s")).select("conv_id", "turn", "s.start", "s.end", F.round("s.score", 4).alias("score"))


def _pieces(text):
    """array<struct<start,end,score>>: runs of up to four word characters, in order."""
    score = lambda x: F.when(x.rlike(r"(?U)^\w"), F.regexp_count(x, F.lit("[A-ZAEIOUaeiou]")) / 4.0).otherwise(0.0)
    found = C.places(text, r"(?U)\w{1,4}|\W+")
    return F.filter(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), score(x["surface"]).alias("score"))), lambda p: p["score"] > 0)


@query("snk07_highlight")
def _(spark, sf):
    scores = F.create_map(*(x for a, s in V.presence_scores(F.col("text")).items() for x in (F.lit(a), s)))
    rows = spread(messages(spark, sf)).withColumn("scores", scores).withColumn("cues", C.pattern_cues(F.col("text"), F.col("scores")))
    return rows.select("conv_id", "turn", R.highlighted(F.col("text"), F.col("cues")).alias("html"))


@query("arr15_secret_safe_spans", f"WITH {MESSAGES}, f AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS type, len(regexp_extract_all(text, {quoted(p)})) AS n FROM msg" for k, p in P.EXPLICIT.items()) + ") SELECT conv_id, turn, CAST(sum(n) AS INTEGER) AS n_spans, false AS has_surface FROM f GROUP BY conv_id, turn")
def _(spark, sf):
    found = spans.explicit_spans(F.col("text"))
    safe = messages(spark, sf).select("conv_id", "turn", F.transform(found, lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"))).alias("s"))
    return safe.select("conv_id", "turn", F.size("s").alias("n_spans"), F.contains(F.to_json("s"), F.lit("surface")).alias("has_surface"))


# -- banks and rewrites ------------------------------------------------------------------------------------------

def bank() -> Bank:
    """A bank made of the fixed city and role lists."""
    out = Bank()
    for city in P.CITIES.split("|"):
        out.add("location", [city], ["my area"])
    for role in P.ROLES.split("|"):
        out.add("occupation", [role], ["a professional"])
    return out


_SURFACES = [(s.lower(), "location") for s in P.CITIES.split("|")] + [(s.lower(), "occupation") for s in P.ROLES.split("|")]


@query("str19_bank_matches", f"WITH {MESSAGES}, b AS (SELECT unnest({_list(s for s, _ in _SURFACES)}) AS surface, unnest({_list(a for _, a in _SURFACES)}) AS attribute), h AS (SELECT conv_id, turn, attribute, surface, lower(text) AS low FROM msg, b WHERE contains(lower(text), surface)) SELECT DISTINCT conv_id, turn, attribute, surface FROM h WHERE regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || surface || '($|[^\\p{{L}}\\p{{N}}_])') AND NOT (surface = 'engineer' AND NOT regexp_matches(replace(low, 'software engineer', ''), '(^|[^\\p{{L}}\\p{{N}}_])engineer($|[^\\p{{L}}\\p{{N}}_])'))")
def _(spark, sf):
    found = banks.matches(F.col("text"), bank())
    rows = spread(messages(spark, sf)).select("conv_id", "turn", F.explode(found).alias("m"))
    return rows.select("conv_id", "turn", "m.attribute", F.lower("m.surface").alias("surface")).distinct()


@query("str20_bank_neutral")
def _(spark, sf):
    rows = spread(messages(spark, sf)).withColumn("m", banks.matches(F.col("text"), bank()))
    return rows.select("conv_id", "turn", banks.neutral(F.col("text"), F.col("m")).alias("neutral"))


@query("aux01_model_free_rewrite")
def _(spark, sf):
    """What is served without a model: pruned, neutral by the bank, scrubbed."""
    rows = spread(messages(spark, sf)).withColumn("p", rewriting.pruned(F.col("text"))).withColumn("m", banks.matches(F.col("p"), bank()))
    return rows.withColumn("n", banks.neutral(F.col("p"), F.col("m"))).select("conv_id", "turn", V.scrubbed(F.col("n"))[0].alias("served"))


_FACTS = ("Denver", "software engineer", "Stanford", "Seattle", "nurse", "Boston", "San Francisco", "34 years old")
_KEPT = ("weather", "hospital", "startup", "law", "campus", "advisor")
_PHRASE = "regexp_matches({}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || x || '($|[^\\p{{L}}\\p{{N}}_])')"
_SCORED = f"""ann AS (SELECT conv_id, turn, text, {_sql_chain('text', P.PLACEHOLDERS)} AS rw, list_filter({_list(_FACTS)}, lambda x: {_PHRASE.format('text')}) AS pii, list_filter({_list(_KEPT)}, lambda x: {_PHRASE.format('text')}) AS inv FROM sen),
    l AS (SELECT *, list_filter(pii, lambda x: {_PHRASE.format('rw')}) AS leaked, list_filter(inv, lambda x: NOT {_PHRASE.format('rw')}) AS missing FROM ann),
    sc AS (SELECT conv_id, turn, pii, inv, leaked, missing, CASE WHEN len(pii) > 0 THEN round(1 - len(leaked) / len(pii)::DOUBLE, 4) END AS removal_rate, CASE WHEN len(inv) > 0 THEN round(1 - len(missing) / len(inv)::DOUBLE, 4) END AS invariant_rate,
           len(pii) > 0 AND trim(rw) = trim(text) AS copied FROM l), st AS (SELECT *, len(leaked) = 0 AND len(missing) = 0 AND NOT copied AS passed FROM sc)"""


def _scored(spark, sf):
    rows = sentences(spark, sf).withColumns({"pii": R.annotated(F.col("text"), _FACTS), "invariants": R.annotated(F.col("text"), _KEPT), "rewrite": V.placeholders(F.col("text"))})
    return R.benchmark_scores(rows)


@query("str21_annotated", f"WITH {SHORT}, {_SCORED} SELECT conv_id, turn, array_to_string(pii, '|') AS pii, array_to_string(inv, '|') AS invariants FROM st")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", F.array_join(R.annotated(F.col("text"), _FACTS), "|").alias("pii"), F.array_join(R.annotated(F.col("text"), _KEPT), "|").alias("invariants"))


@query("str22_benchmark_scores", f"WITH {SHORT}, {_SCORED} SELECT conv_id, turn, array_to_string(leaked, '|') AS leaked, removal_rate, array_to_string(missing, '|') AS missing, invariant_rate, copied, passed FROM st")
def _(spark, sf):
    return _scored(spark, sf).select("conv_id", "turn", F.array_join("leaked", "|").alias("leaked"), "removal_rate", F.array_join("missing", "|").alias("missing"), "invariant_rate", "copied", "passed")


@query("agg34_benchmark_summary", f"WITH {SHORT}, {_SCORED} SELECT conv_id % 5 AS category, count(*) AS total, count(*) FILTER (WHERE passed) AS passed, round(avg(removal_rate), 4) AS mean_removal_rate, round(avg(invariant_rate), 4) AS mean_invariant_rate, count(*) FILTER (WHERE copied) AS copied, CAST(sum(len(leaked)) AS BIGINT) AS leaked FROM st GROUP BY 1")
def _(spark, sf):
    return R.benchmark_summary(_scored(spark, sf).withColumn("category", F.col("conv_id") % 5), "category")


@query("str32_edit_ratio")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", F.round(R.edit_ratio(F.col("text"), F.col("other")), 6).alias("ratio"))


@query("agg18_utility_rollup", f"WITH {_PAIR}, d AS (SELECT *, {_DEG} AS reason FROM pair) SELECT count(*) AS n, round(avg(round(cosine, 6)), 4) AS mean_cosine, round(count(reason) / count(*)::DOUBLE, 4) AS degeneracy_rate, round(count(*) FILTER (WHERE cosine >= 0.9 AND reason IS NULL) / count(*)::DOUBLE, 4) AS preserved_rate FROM d")
def _(spark, sf):
    rows = sentences(spark, sf).select(T.token_cosine(F.col("text"), F.col("other")).alias("c"), T.degeneracy(F.col("text"), F.col("other")).alias("reason"))
    n = F.count("*")
    return rows.agg(n.alias("n"), F.round(F.avg(F.round("c", 6)), 4).alias("mean_cosine"), F.round(F.count("reason") / n, 4).alias("degeneracy_rate"), F.round(F.count_if((F.col("c") >= 0.9) & F.col("reason").isNull()) / n, 4).alias("preserved_rate"))


_LEAKY = "CASE WHEN {x} <> {s} THEN 1 ELSE 0 END"


@query("str45_safest_attempt", f"""WITH {SHORT}, c AS (SELECT conv_id, turn, 0 AS attempt, text FROM sen UNION ALL SELECT conv_id, turn, 1, {_sql_chain('text', [(p, t) for t, p in P.HARD_SCRUB], 'g')} FROM sen
    UNION ALL SELECT conv_id, turn, 2, {_sql_chain('text', P.PLACEHOLDERS)} FROM sen), s AS (SELECT *, {_sql_scores()} FROM (SELECT *, {LOW} AS low FROM c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN {_sql_chain('text', [(p, t) for t, p in P.HARD_SCRUB], 'g')} <> text THEN 1 ELSE 0 END, greatest(age, location, occupation, education), attempt) AS k FROM s)
    SELECT conv_id, turn, attempt, text FROM r WHERE k = 1""")
def _(spark, sf):
    rows = sentences(spark, sf).withColumn("c", F.array("text", V.scrubbed(F.col("text"))[0], V.placeholders(F.col("text"))))
    return R.safest(rows, "c").select("conv_id", "turn", "safest.attempt", "safest.text")


# -- answers and training rows -----------------------------------------------------------------------------------

@query("str34_cleaned_answer", f"WITH {MESSAGES} SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 2 = 0 THEN trim(trim(text)) ELSE trim(text) END AS cleaned FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\"“”'']', '', 'g'), '^\\s+', '') AS text FROM msg)")
def _(spark, sf):
    """Answers wrapped in thinking, labels and quotes come back as the bare text."""
    bare = F.ltrim(F.regexp_replace("text", "[\"“”']", ""))
    wrapped = F.when((F.col("conv_id") + F.col("turn")) % 2 == 0, F.concat(F.lit("<think>I\nwonder</think> Rewrite: \""), bare, F.lit('"'))).otherwise(F.concat(F.lit("Output : “"), F.trim(bare), F.lit("”")))
    return messages(spark, sf).select("conv_id", "turn", R.cleaned_answer(wrapped).alias("cleaned"))


_BODY = "trim(regexp_replace(text, '[^A-Za-z,]+', ' ', 'g'))"


@query("str34_finished_answers", f"WITH {MESSAGES} SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN 'fallback' ELSE {_BODY} END AS answer FROM msg")
def _(spark, sf):
    """Answers as models give them: other turns, nested and open thinking, labels, fences in quotes, notes and tags behind, and
    nothing at all. Before each stands a filler: of two, only the first is the model's."""
    body = F.trim(F.regexp_replace("text", "[^A-Za-z,]+", " "))
    put = lambda before, behind: F.concat(F.lit(before), body, F.lit(behind))
    wrapped = F.element_at(F.array(
        put("<|im_start|>system\nhidden<|im_end|><think>a <think>b</think> c</think>Sure! ```text\n\"", "\"\n```"), put("junk</think>noise</THINK> **Rewritten text:** Okay, ", " 😀 😀 more"),
        put("<|im_start|>assistant\nold<|im_end|><|im_start|>assistant\nSure! ", "<think>and never closed"), put("Here is the result: ", " #one #two\nNote: This rewrite is short."), F.lit("<think>nothing</think> N/A"),
    ), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    rows = messages(spark, sf).select("conv_id", "turn", F.concat(F.lit("x "), "text").alias("original"), wrapped.alias("raw"))
    return A.finished(rows, "raw", "original", lambda c: c, lambda c: F.lit("fallback"), lambda c: F.lit(True)).select("conv_id", "turn", "answer")


_JOBS = ("software developer", "hospital nurse", "UNKNOWN", "us_west dreamer", "n/a", "business_finance")


@query("str36_json_answers", f"""WITH v AS (SELECT o_orderkey AS id, list_extract({_list(_JOBS)}, CAST(o_custkey % 6 AS INTEGER) + 1) AS j, CAST(20 + o_custkey % 50 AS INTEGER) AS age FROM orders)
    SELECT id, CASE WHEN lower(j) IN ('unknown', 'n/a') THEN 'UNKNOWN' WHEN j = 'business_finance' THEN j ELSE {_sql_cascade('lower(j)', P.CASCADE_EVAL['occupation'])} END AS occupation,
        CASE WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54' ELSE '55+' END AS age, 'UNKNOWN' AS education FROM v""")
def _(spark, sf):
    """Answers as plain JSON, in prose, after a broken object, and without JSON at all."""
    job = F.element_at(F.array(*map(F.lit, _JOBS)), (F.col("o_custkey") % 6 + 1).cast("int"))
    age = (20 + F.col("o_custkey") % 50).cast("string")
    body = F.concat(F.lit('{"Age": "'), age, F.lit('", "occupation": "'), job, F.lit('"}'))
    loose = F.concat(F.lit("My guess:\nage = "), age, F.lit(",\noccupation: "), job, F.lit("\nthat is all"))
    forms = F.array(body, F.concat(F.lit("Sure! Here: "), body, F.lit(" Hope it helps.")), F.concat(F.lit("{not json} but "), body), loose)
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), R.answer_values(F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("v"))
    return rows.select("id", *(R.answer_label(a, F.col("v")).alias(a) for a in ("occupation", "age", "education")))


_SYSTEM, _INSTRUCTION = "Rewrite the message without personal cues.", "Generalise."


@query("prj04_training_rows", f"WITH {SHORT} SELECT conv_id, turn, '{_SYSTEM}' || '|' || text || '|' || trim(other) AS chat, '{_INSTRUCTION}' || '|' || trim(other) AS instruction FROM sen")
def _(spark, sf):
    rows = sentences(spark, sf).withColumn("answer", F.concat(F.lit("<think>\nhm</think> "), "other"))
    chat = F.array_join(F.transform(R.chat_row(F.col("text"), F.col("answer"), _SYSTEM), lambda m: m["content"]), "|")
    own = R.instruction_row(F.col("text"), F.col("answer"), _INSTRUCTION)
    return rows.select("conv_id", "turn", chat.alias("chat"), F.concat(own["instruction"], F.lit("|"), own["output"]).alias("instruction"))


@query("prj05_cue_instruction")
def _(spark, sf):
    rows = spread(messages(spark, sf)).withColumns({k: v for k, v in V.rule_scores(F.col("text")).items()})
    rows = rows.withColumn("cues", C.pattern_cues(F.col("text"), F.create_map(*(x for a in P.ATTRIBUTES for x in (F.lit(a), F.col(a))))))
    return rows.select("conv_id", "turn", R.cue_instruction({a: F.col(a) for a in P.ATTRIBUTES}, F.col("cues"), F.col("text")).alias("prompt"))


@query("prj06_numbered_turns", "SELECT conv_id, string_agg('Turn ' || k || ': ' || coalesce(text, ''), chr(10) ORDER BY k) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id")
def _(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return read(spark, sf, "conversations").groupBy("conv_id").agg(R.numbered_turns(turns).alias("prompt"))


@query("prj02_backfilled", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, c_mktsegment) AS status, coalesce(CASE WHEN o_orderkey % 2 > 0 THEN o_orderpriority END, c_mktsegment) AS priority FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.struct(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderpriority")).alias("priority")).alias("own"))
    p = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("profile"))
    return o.join(p, "k").select("id", F.coalesce("own.status", "profile").alias("status"), F.coalesce("own.priority", "profile").alias("priority"))


# -- samples -----------------------------------------------------------------------------------------------------

_WEIGHTS = {"location": 0.35, "occupation": 0.3, "age": 0.2, "education": 0.15}


@query("smp03_weighted_sample", "WITH w AS (SELECT o_orderkey AS id, unnest(['location', 'occupation', 'age', 'education']) AS item, unnest([0.35::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE, 0.15::DOUBLE]) AS w FROM orders), d AS (SELECT id, item, ln((CAST('0x' || substr(md5(concat_ws('|', CAST(id AS VARCHAR), item, '7')), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE) / w AS o FROM w) SELECT id, item FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, item) AS k FROM d) WHERE k <= 2")
def _(spark, sf):
    items = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(w).alias("w")) for a, w in _WEIGHTS.items())))
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), items.alias("i")).select("id", "i.a", "i.w")
    return R.weighted_sample(rows, "id", F.col("a"), F.col("w"), 2, 7)


@query("smp04_first_of_equals", "SELECT min(o_orderkey) AS id, CAST(o_custkey % 97 AS BIGINT) AS made FROM orders GROUP BY 2 ORDER BY 1 LIMIT 40")
def _(spark, sf):
    """Generated inputs: the first of equal ones stays, and the first forty of these are taken."""
    rows = read(spark, sf, "orders").groupBy((F.col("o_custkey") % 97).cast("long").alias("made")).agg(F.min("o_orderkey").alias("id"))
    return rows.orderBy("id").limit(40).select("id", "made")


@query("top06_pareto_quota", "WITH a AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders), u AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F') SELECT id FROM u, a WHERE k <= greatest(1, CAST(floor(a.n * 0.05::DOUBLE / greatest(1 - 0.05::DOUBLE, 0.01)) AS BIGINT))")
def _(spark, sf):
    o = read(spark, sf, "orders")
    n = max(1, int(o.where("o_orderstatus = 'F'").count() * 0.05 / max(1 - 0.05, 0.01)))
    return o.where("o_orderstatus <> 'F'").orderBy("o_orderkey").limit(n).select(F.col("o_orderkey").alias("id"))


@query("top07_until_enough", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 25")
def _(spark, sf):
    """The first accepted rows, in order, until there are enough: a top-k that every task does for itself first."""
    return read(spark, sf, "orders").where("o_totalprice > 100000").orderBy("o_orderkey").limit(25).select(F.col("o_orderkey").alias("id"))


@query("top08_head", "SELECT conv_id, turn FROM conversations ORDER BY conv_id, turn LIMIT 30")
def _(spark, sf):
    return read(spark, sf, "conversations").orderBy("conv_id", "turn").limit(30).select("conv_id", "turn")


# -- records, sinks, sessions ------------------------------------------------------------------------------------

@query("arr08_legacy_records", """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '3-5' WHEN 1 THEN '4.5' WHEN 2 THEN 'fine' ELSE '-' END AS u, CASE o_orderkey % 3 WHEN 0 THEN '(age; city , job)' WHEN 1 THEN '' ELSE 'age' END AS a, o_orderkey % 12 + 1 AS m, o_orderkey % 28 + 1 AS d FROM orders)
    SELECT id, CASE u WHEN '3-5' THEN 4.0::DOUBLE WHEN '4.5' THEN 4.5::DOUBLE ELSE 5.0::DOUBLE END AS usefulness, CASE a WHEN '(age; city , job)' THEN 'age|city|job' WHEN 'age' THEN 'age' END AS anchors, '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS day FROM r""")
def _(spark, sf):
    k = F.col("o_orderkey")
    u = F.when(k % 4 == 0, "3-5").when(k % 4 == 1, "4.5").when(k % 4 == 2, "fine").otherwise("-")
    a = F.when(k % 3 == 0, "(age; city , job)").when(k % 3 == 1, "").otherwise("age")
    day = F.concat_ws("/", k % 12 + 1, k % 28 + 1, F.lit("2024"))
    return read(spark, sf, "orders").select(k.alias("id"), R.usefulness(u).alias("usefulness"), F.array_join(R.anchors(a), "|").alias("anchors"), R.iso_date(day).alias("day"))


@query("snk02_training_sinks", f"WITH {SHORT} SELECT 'chat' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM sen UNION ALL SELECT 'instruction', count(*), CAST(sum(length(text)) AS BIGINT) FROM sen")
def _(spark, sf):
    """Both kinds of training rows as JSON lines, read back."""
    path, rows = shared_folder(spark), sentences(spark, sf)
    rows.select(R.chat_row(F.col("text"), F.col("other"), _SYSTEM).alias("messages")).write.json(f"{path}/chat")
    rows.select(R.instruction_row(F.col("text"), F.col("other"), _INSTRUCTION).alias("r")).select("r.*").write.json(f"{path}/instruction")
    chat = spark.read.schema("messages array<struct<role:string,content:string>>").json(f"{path}/chat").select(F.lit("chat").alias("kind"), F.col("messages")[1]["content"].alias("t"))
    own = spark.read.schema("instruction string, input string, output string").json(f"{path}/instruction").select(F.lit("instruction").alias("kind"), F.col("input").alias("t"))
    return chat.unionByName(own).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("t")).alias("chars"))


@query("snk04_telemetry_append", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    """Events appended to a JSON log by a stream that runs until its input is read; identifiers are not logged."""
    path = shared_folder(spark)
    read(spark, sf, "events").select("event_id", "event_type").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("event_id long, event_type string").parquet(f"{path}/in").select("event_type")
    stream.writeStream.format("json").option("path", f"{path}/log").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string").json(f"{path}/log").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm07_session_store", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS messages, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS from_user FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("from_user"))


@query("stm06_reset", "WITH e AS (SELECT user_id, event_type, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events), l AS (SELECT user_id, max(era) AS era FROM e GROUP BY user_id) SELECT e.user_id, count(*) FILTER (WHERE e.event_type <> 'signup') AS since FROM e JOIN l ON l.user_id = e.user_id AND l.era = e.era GROUP BY e.user_id")
def _(spark, sf):
    """Events of each user since the last reset (a signup): the latest reset is one partial aggregate, no state is kept in order."""
    e = read(spark, sf, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "signup", F.col("at"))).alias("reset"))
    rows = e.join(last, "user_id").where("reset IS NULL OR at >= reset")
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") != "signup").alias("since"))


_NAMED = f"""{MESSAGES}, tx AS (SELECT conv_id, turn, {PLAIN} AS text FROM msg), fd AS (SELECT conv_id, turn, 'PER' AS kind, regexp_extract_all(text, '\\b[A-Z][a-z]+\\b') AS found FROM tx
    UNION ALL SELECT conv_id, turn, 'ID', regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][a-z]+') FROM tx),
    ent AS (SELECT conv_id, turn, kind, unnest(found) AS entity, turn * 1000000 + unnest(range(len(found))) AS place FROM fd),
    f AS (SELECT CAST(conv_id AS VARCHAR) AS session, kind, sha256('pepper' || lower(trim(entity))) AS digest, min(place) AS place FROM ent GROUP BY ALL)"""


@query("str25_vault", f"WITH {_NAMED} SELECT session, kind, '[' || kind || '_' || row_number() OVER (PARTITION BY session, kind ORDER BY place, digest) || ']' AS token, digest FROM f")
def _(spark, sf):
    """The vault of every name and address in the messages, learned in two runs: first the early turns, then the others."""
    rows = messages(spark, sf).select("conv_id", "turn", F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x").alias("text"))
    found = [rows.select("conv_id", "turn", F.lit(kind).alias("kind"), F.posexplode(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("i", "entity")) for kind, p in (("PER", r"\b[A-Z][a-z]+\b"), ("ID", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][a-z]+"))]
    entities = found[0].unionByName(found[1]).select(F.col("conv_id").alias("session"), "turn", "kind", "entity", (F.col("turn") * 1_000_000 + F.col("i")).alias("at"))
    vault = Vault(spark, shared_folder(spark), secret="a secret that a caller keeps", salt="pepper")
    vault.learn(entities.where("turn < 3"))
    vault.learn(entities)
    return vault.entries().select("session", "kind", Vault.token().alias("token"), "digest")


# -- model seams -------------------------------------------------------------------------------------------------

def _jaccard(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x | y else 1.0


@query("udf02_pair_model", "WITH {}, s AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(other), '\\s+'), lambda x: x <> '')) AS b FROM sen) SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS score FROM s".format(SHORT))
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", F.round(R.paired(_jaccard)(F.col("text"), F.col("other")), 6).alias("score"))


@query("udf04_rewriter_model", f"WITH {MESSAGES} SELECT conv_id, turn, upper(text) AS rewrite FROM (SELECT conv_id, turn, {PLAIN} AS text FROM msg)")
def _(spark, sf):
    plain = F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x")
    return messages(spark, sf).select("conv_id", "turn", R.rewriter(lambda: str.upper)(plain).alias("rewrite"))


def _small_memory(texts: list[str]) -> list[str]:
    if len(texts) > 5:
        raise MemoryError
    return [t[::-1] for t in texts]


@query("udf05_generate_halving", f"WITH {MESSAGES} SELECT conv_id, turn, reverse(text) AS generated FROM (SELECT conv_id, turn, {PLAIN} AS text FROM msg)")
def _(spark, sf):
    rows = messages(spark, sf).select("conv_id", "turn", F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x").alias("text"))
    return R.generated(rows, "text", _small_memory).select("conv_id", "turn", "generated")


@query("udf09_fitted_temperatures")
def _(spark, sf):
    o = read(spark, sf, "orders")
    z = F.array((F.col("o_custkey") % 7).cast("double"), (F.col("o_orderkey") % 5).cast("double"), (F.col("o_custkey") % 3).cast("double"))
    rows = o.select(F.element_at(F.array(*map(F.lit, P.ATTRIBUTES)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("attribute"), z.alias("logits"), ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 4 - 1).cast("int").alias("label"))
    return R.fitted_temperatures(rows)


@query("agg37_reportability", f"""WITH {STUDY}, g AS (SELECT scenario, count(*) AS n, count(risk_score) AS scored, count(*) FILTER (WHERE deviation) AS bad FROM study GROUP BY scenario)
    SELECT scenario, CASE WHEN scored < n * 0.5 THEN 'BLOCKED' WHEN bad * 10 > n THEN 'DIAGNOSTIC_ONLY' ELSE 'PASS' END AS status, array_to_string(list_filter([CASE WHEN scored < n * 0.5 THEN 'few scores' END, CASE WHEN bad * 10 > n THEN 'deviations' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
def _(spark, sf):
    g = records(spark, sf).groupBy("scenario").agg(F.count("*").alias("n"), F.count("risk_score").alias("scored"), F.count_if("deviation").alias("bad"))
    few, deviant = F.col("scored") < F.col("n") * 0.5, F.col("bad") * 10 > F.col("n")
    status = F.when(few, "BLOCKED").when(deviant, "DIAGNOSTIC_ONLY").otherwise("PASS")
    return g.select("scenario", status.alias("status"), F.array_join(F.array_compact(F.array(F.when(few, "few scores"), F.when(deviant, "deviations"))), ",").alias("reasons"))
