"""Queries over messages: identifiers, risk, labels, attackers, rewrites, utility, leakage; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import leakage as L
from quillstone.plans.inputs import GUESSES, MESSAGES, SHORT, guesses, messages, quoted, sentences

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# SQL building blocks. RE2 knows only ASCII words, so accented letters are first turned into plain ones where words count.
LOW = "regexp_replace(lower(text), '[ß-öø-ÿ]', 'x', 'g')"
PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', 'x', 'g')"
TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _rx(x: str, p: str) -> str:
    return f"regexp_matches({x}, {quoted(p)})"


def _sub(x: str, p: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {quoted(p)}, {quoted(by)}, '{flags}')"


def _sql_chain(x: str, rules, flags: str = "gi") -> str:
    for p, by in rules:
        x = _sub(x, p, by, flags)
    return x


def _sql_scores() -> str:
    out = []
    for a, cues in P.RULE_CUES.items():
        n = " + ".join(f"len(regexp_extract_all(low, {quoted(c)}))" for c in cues)
        out.append(f"CASE {n} WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.45::DOUBLE WHEN 2 THEN 0.75::DOUBLE ELSE 0.95::DOUBLE END AS {a}")
    return ", ".join(out)


def _sql_cascade(x: str, rules) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({x}, {quoted(k)})' for k in keys)} THEN {quoted(label)}" for label, keys in rules[:-1])
    return f"CASE {whens} ELSE {quoted(rules[-1][0])} END"


def _sql_age(n: str) -> str:
    return f"CASE WHEN {n} < 25 THEN '18-24' WHEN {n} < 35 THEN '25-34' WHEN {n} < 45 THEN '35-44' WHEN {n} < 55 THEN '45-54' ELSE '55+' END"


_REDACT = "text"
for _k, _p in P.EXPLICIT.items():
    if _k == "PERSON":
        _REDACT = _sub(_REDACT, f"({P.PERSON_LEAD})({P.PERSON_NAME})\\b", "\\1<PERSON>")
    elif _k == "LOCATION":
        _REDACT = _sub(_REDACT, f"({P.PLACE_LEAD})({P.PLACE_NAME})\\b", "\\1<LOCATION>")
    else:
        _REDACT = _sub(_REDACT, _p, f"<{_k}>")
_TYPES = "list_filter([" + ", ".join(f"CASE WHEN {_rx(PLAIN, p)} THEN '{k}' END" for k, p in P.EXPLICIT.items()) + "], lambda x: x IS NOT NULL)"
_INDIRECT = " OR ".join(_rx(LOW, p) for p in P.INDIRECT)
_SCRUB = _sql_chain("text", [(p, tag) for tag, p in P.HARD_SCRUB], "g")
_SCORES = f"{MESSAGES}, s AS (SELECT conv_id, turn, role, {_sql_scores()} FROM (SELECT *, {LOW} AS low FROM msg))"


@query("str05_redact", f"WITH {MESSAGES} SELECT conv_id, turn, {_REDACT} AS redacted FROM msg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("conv_id", "turn", V.redacted(F.col("text")).alias("redacted"))


@query("str06_entity_types", f"WITH {MESSAGES} SELECT conv_id, turn, array_to_string({_TYPES}, ',') AS types FROM msg")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.array_join(V.entity_types(F.col("text")), ",").alias("types"))


@query(
    "flt10_hardness",
    f"""WITH {MESSAGES}, h AS (SELECT len({_TYPES}) > 0 AS e, ({_INDIRECT}) AS i FROM msg)
        SELECT CASE WHEN e AND i THEN 'complicated' WHEN e THEN 'direct' WHEN i THEN 'indirect' ELSE 'direct' END AS hardness, count(*) AS n FROM h GROUP BY 1""",
)
def _(spark, sf):
    return messages(spark, sf).groupBy(V.hardness(F.col("text")).alias("hardness")).agg(F.count("*").alias("n"))


@query("str08_scrub", f"WITH {MESSAGES} SELECT conv_id, turn, {_SCRUB} AS scrubbed, {_SCRUB} <> text AS had_pii FROM msg")
def _(spark, sf):
    out, had = V.scrubbed(F.col("text"))
    return messages(spark, sf).select("conv_id", "turn", out.alias("scrubbed"), had.alias("had_pii"))


@query("str09_rule_scores", f"WITH {_SCORES} SELECT conv_id, turn, age, location, occupation, education, greatest(age, location, occupation, education) AS overall FROM s")
def _(spark, sf):
    s = V.rule_scores(F.col("text"))
    return messages(spark, sf).select("conv_id", "turn", *(s[a].alias(a) for a in P.ATTRIBUTES), F.greatest(*s.values()).alias("overall"))


_PRESENCE = ", ".join(f"CASE WHEN {' OR '.join(_rx('low', c) for c in cues)} THEN 0.72::DOUBLE ELSE 0.12::DOUBLE END AS {a}" for a, cues in P.PRESENCE_CUES.items())


@query("str10_presence_scores", f"WITH {MESSAGES} SELECT conv_id, turn, {_PRESENCE} FROM (SELECT *, {LOW} AS low FROM msg)")
def _(spark, sf):
    s = V.presence_scores(F.col("text"))
    return messages(spark, sf).select("conv_id", "turn", *(s[a].alias(a) for a in P.ATTRIBUTES))


def _sql_blend() -> str:
    rule = f"r AS (SELECT conv_id, turn, low, {_sql_scores()}, ((conv_id * 13 + turn * 7) % 100) / 100.0::DOUBLE AS m FROM (SELECT *, {LOW} AS low FROM msg))"
    base = ", ".join(
        f"round(CASE WHEN {a} >= 0.75 THEN greatest(m, {a}) WHEN {a} = 0.45 THEN least(greatest(m, 0.45::DOUBLE), 0.50::DOUBLE) WHEN m < 0.50 THEN least(m, 0.15::DOUBLE) ELSE least(m, 0.50::DOUBLE) END, 4) AS {a}"
        for a in P.ATTRIBUTES
    )
    other = f"NOT {_rx('low', P.SELF_WORDS)} AND NOT {_rx('low', P.SELF_PHRASES)}"
    boosts = {a: f"CASE WHEN {_rx('low', p)} THEN greatest({a}, {least}::DOUBLE) ELSE {a} END" for a, least, p in P.BOOSTS}
    boosts["age"] = f"CASE WHEN {_rx('low', P.OTHERS_AGE)} AND NOT {_rx('low', P.OWN_AGE)} THEN least({boosts['age']}, 0.15::DOUBLE) ELSE {boosts['age']} END"
    last = ", ".join(f"CASE WHEN other THEN least({a}, 0.15::DOUBLE) ELSE {boosts[a]} END AS {a}" for a in P.ATTRIBUTES)
    return f"WITH {MESSAGES}, {rule}, b AS (SELECT conv_id, turn, low, {other} AS other, {base} FROM r) SELECT conv_id, turn, {last} FROM b"


@query("str12_blended_scores", _sql_blend())
def _(spark, sf):
    m = F.pmod(F.col("conv_id") * 13 + F.col("turn") * 7, F.lit(100)) / 100.0
    s = V.blended_scores(F.col("text"), dict.fromkeys(P.ATTRIBUTES, m))
    return messages(spark, sf).select("conv_id", "turn", *(s[a].alias(a) for a in P.ATTRIBUTES))


@query("flt09_impersonal", f"WITH {MESSAGES} SELECT conv_id, turn, NOT {_rx('low', P.SELF_WORDS)} AND NOT {_rx('low', P.SELF_PHRASES)} AS impersonal FROM (SELECT *, {LOW} AS low FROM msg)")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", V.impersonal(F.col("text")).alias("impersonal"))


@query("str14_keyword_cues", f"""WITH {MESSAGES}, k AS (SELECT unnest([{", ".join(f"{{'a': '{a}', 'k': {quoted(k)}}}" for a, ks in P.FALLBACK_CUES.items() for k in ks)}]) AS x)
    SELECT conv_id, turn, x.a AS attribute, x.k AS cue, CAST(instr(lower(text), x.k) - 1 AS INTEGER) AS start FROM msg, k WHERE contains(lower(text), x.k)""")
def _(spark, sf):
    cues = F.array(*(F.struct(F.lit(a).alias("attribute"), F.lit(k).alias("cue")) for a, ks in P.FALLBACK_CUES.items() for k in ks))
    low = F.lower("text")
    rows = messages(spark, sf).select("conv_id", "turn", low.alias("low"), F.explode(F.filter(cues, lambda c: F.contains(low, c["cue"]))).alias("c"))
    return rows.select("conv_id", "turn", "c.attribute", "c.cue", F.expr("cast(instr(low, c.cue) - 1 as int)").alias("start"))


@query("str15_neutral", f"WITH {SHORT} SELECT conv_id, turn, " + ", ".join(f"{_sql_chain('text', P.NEUTRAL[a])} AS {a}" for a in P.ATTRIBUTES) + " FROM sen")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", *(V.neutral(F.col("text"), a).alias(a) for a in P.ATTRIBUTES))


@query("str16_placeholders", f"WITH {SHORT} SELECT conv_id, turn, {_sql_chain('text', P.PLACEHOLDERS)} AS tagged FROM sen")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", V.placeholders(F.col("text")).alias("tagged"))


# --- tokens, similarity, entailment, utility ---

_PAIR = f"""{SHORT}, tk AS (SELECT conv_id, turn, {TOK.format('text')} AS ta, {TOK.format('other')} AS tb FROM sen),
    wa AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(ta) AS w FROM tk) GROUP BY ALL),
    wb AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(tb) AS w FROM tk) GROUP BY ALL),
    dot AS (SELECT wa.conv_id, wa.turn, sum(wa.n * wb.n) AS d FROM wa JOIN wb USING (conv_id, turn, w) GROUP BY ALL),
    na AS (SELECT conv_id, turn, sum(n * n) AS q FROM wa GROUP BY ALL), nb AS (SELECT conv_id, turn, sum(n * n) AS q FROM wb GROUP BY ALL),
    pair AS (SELECT tk.conv_id, tk.turn, ta, tb, list_distinct(ta) AS sa, list_distinct(tb) AS sb,
        CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE ELSE coalesce(d, 0) / (sqrt(na.q) * sqrt(nb.q)) END AS cosine
        FROM tk LEFT JOIN dot USING (conv_id, turn) LEFT JOIN na USING (conv_id, turn) LEFT JOIN nb USING (conv_id, turn))"""


def _neg(s: str, which) -> str:
    return f"len(list_intersect({s}, [{', '.join(map(quoted, which))}]))"


def _ent(p: str, h: str) -> tuple[str, str]:
    c = f"CASE WHEN len({h}) = 0 THEN 0.0::DOUBLE WHEN {_neg(p, P.NEGATIONS_A)} <> {_neg(h, P.NEGATIONS_A)} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"CASE WHEN len({h}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({p}, {h})) / len({h})::DOUBLE * (1 - {c}) END", c


_F, _C1 = _ent("sa", "sb")
_B, _C2 = _ent("sb", "sa")
_REP = "(CASE WHEN len({0}) > 0 THEN (len({0}) - len(list_distinct({0}))) / len({0})::DOUBLE ELSE 0.0 END)"
_NON = "(CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda t: NOT regexp_matches(t, '[a-z]'))) / len({0})::DOUBLE ELSE 0.0 END)"
_DEG = f"""CASE WHEN len(tb) = 0 THEN 'empty' WHEN len(tb) >= 4 AND {_REP.format('tb')} - {_REP.format('ta')} >= 0.25 THEN 'repetition'
    WHEN len(ta) >= 4 AND NOT (len(tb) / len(ta)::DOUBLE BETWEEN 0.25 AND 3.0) THEN 'length'
    WHEN {_NON.format('tb')} > 0.5 AND {_NON.format('tb')} - {_NON.format('ta')} >= 0.25 THEN 'non_alphabetic' END"""
_UTIL = f"""u AS (SELECT conv_id, turn, cosine, {_F} AS f, {_B} AS b, greatest({_C1}, {_C2}) AS c, {_DEG} AS reason FROM pair),
    util AS (SELECT conv_id, turn, round(cosine, 4) AS cosine, round(f, 4) AS forward, round(b, 4) AS backward, round(c, 4) AS contradiction,
        round(CASE WHEN reason IS NULL THEN greatest(0.0, least(1.0, 0.45 * cosine + 0.30 * f + 0.25 * b - 0.50 * c)) ELSE 0.0 END, 4) AS utility, reason FROM u)"""


@query("str01_tokens", f"WITH {MESSAGES} SELECT conv_id, turn, array_to_string({TOK.format('text')}, ' ') AS tokens FROM msg")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("str02_alnum_tokens", f"WITH {MESSAGES} SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM msg")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", F.array_join(T.alnum_tokens(F.col("text")), " ").alias("tokens"))


@query("str27_token_cosine", f"WITH {_PAIR} SELECT conv_id, turn, round(cosine, 6) AS cosine FROM pair")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", F.round(T.token_cosine(F.col("text"), F.col("other")), 6).alias("cosine"))


@query("str26_degeneracy", f"WITH {_PAIR} SELECT conv_id, turn, {_DEG} AS reason FROM pair")
def _(spark, sf):
    return sentences(spark, sf).select("conv_id", "turn", T.degeneracy(F.col("text"), F.col("other")).alias("reason"))


@query("str29_entailment", f"WITH {_PAIR} SELECT conv_id, turn, round({_F}, 6) AS entailment, {_C1} AS contradiction FROM pair")
def _(spark, sf):
    e, c = T.entailment_a(F.col("text"), F.col("other"))
    return sentences(spark, sf).select("conv_id", "turn", F.round(e, 6).alias("entailment"), c.alias("contradiction"))


_NB = f"CASE WHEN {_neg('sa', P.NEGATIONS_B)} <> {_neg('sb', P.NEGATIONS_B)} THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"
_BOTH = "len(list_intersect(sa, sb))"


@query(
    "str30_entailment_b",
    f"""WITH {_PAIR}, e AS (SELECT conv_id, turn, {_BOTH} / greatest(len(sb), 1)::DOUBLE AS f, {_BOTH} / greatest(len(sa), 1)::DOUBLE AS b, {_NB} AS c FROM pair)
        SELECT conv_id, turn, round(f, 4) AS forward, round(b, 4) AS backward, round(c, 4) AS contradiction, round(greatest(0.0, least(1.0, 0.5 * f + 0.5 * b - 0.5 * c)), 4) AS composite FROM e""",
)
def _(spark, sf):
    e = T.entailment_b(F.col("text"), F.col("other"))
    return sentences(spark, sf).select("conv_id", "turn", *(v.alias(k) for k, v in e.items()))


@query("str33_utility", f"WITH {_PAIR}, {_UTIL} SELECT *, cosine >= 0.82 AND utility >= 0.60 AND contradiction <= 0.20 AND reason IS NULL AS acceptable FROM util")
def _(spark, sf):
    m = T.utility(F.col("text"), F.col("other"))
    rows = sentences(spark, sf).select("conv_id", "turn", *(v.alias(k) for k, v in m.items()))
    return rows.withColumn("acceptable", T.acceptable({k: F.col(k) for k in m}))


@query("flt15_changed", f"WITH {MESSAGES} SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> trim(regexp_replace(other, '\\s+', ' ', 'g')) AS changed, sha256(text) AS served FROM msg")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", (T.squeezed(F.col("text")) != T.squeezed(F.col("other"))).alias("changed"), F.sha2("text", 256).alias("served"))


@query("flt02_min_length", f"WITH {MESSAGES} SELECT role, count(*) FILTER (WHERE length(trim(text)) >= 10) AS kept, count(*) FILTER (WHERE length(trim(text)) < 10) AS dropped FROM msg GROUP BY role")
def _(spark, sf):
    long = F.length(F.trim("text")) >= 10
    return messages(spark, sf).groupBy("role").agg(F.count_if(long).alias("kept"), F.count_if(~long).alias("dropped"))


# --- labels and attackers ---

_EVAL = {a: f"CASE WHEN v = '' THEN 'UNKNOWN' ELSE {_sql_cascade('v', r)} END" for a, r in P.CASCADE_EVAL.items()}
_EVAL["age"] = f"CASE WHEN regexp_extract(v, '\\d+') = '' THEN 'UNKNOWN' ELSE {_sql_age(chr(67) + 'AST(regexp_extract(v, ' + quoted(chr(92) + 'd+') + ') AS INTEGER)')} END"
_LABELED = f"{GUESSES}, lab AS (SELECT id, method, attribute, truth, guess, CASE " + " ".join(f"WHEN attribute = '{a}' THEN {x}" for a, x in _EVAL.items()) + " END AS label FROM (SELECT *, lower(trim(coalesce(truth, ''))) AS v FROM guesses))"


def eval_label(attribute, truth):
    label = F.lit(None).cast("string")
    for a in P.ATTRIBUTES:
        label = F.when(attribute == a, V.taxonomy_label(a, truth)).otherwise(label)
    return label


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    return guesses(spark, sf).withColumn("label", eval_label(F.col("attribute"), F.col("truth")))


@query("flt05_taxonomy_label", f"WITH {_LABELED} SELECT attribute, truth, label, count(*) AS n FROM lab GROUP BY ALL")
def _(spark, sf):
    return labeled(spark, sf).groupBy("attribute", "truth", "label").agg(F.count("*").alias("n"))


def _sql_ids() -> str:
    out = []
    for a, names in P.TAXONOMY.items():
        if a == "age":
            x = _sql_age("coalesce(try_cast(nullif(regexp_extract(v, '\\d+'), '') AS INTEGER), 30)")
        else:
            x = _sql_cascade("v", tuple((k, P.ASIA_TRAIN if k == "asia_pacific" else w) for k, w in P.CASCADE_EVAL[a]))
        out.append(f"WHEN attribute = '{a}' THEN list_position([{', '.join(map(quoted, names))}], {x}) - 1")
    return "CASE " + " ".join(out) + " END"


@query("flt07_taxonomy_id", f"WITH {GUESSES} SELECT attribute, truth, CAST({_sql_ids()} AS INTEGER) AS label_id, count(*) AS n FROM (SELECT *, lower(trim(coalesce(truth, ''))) AS v FROM guesses) GROUP BY ALL")
def _(spark, sf):
    out = F.lit(None).cast("int")
    for a in P.ATTRIBUTES:
        out = F.when(F.col("attribute") == a, V.taxonomy_id(a, F.col("truth"))).otherwise(out)
    return guesses(spark, sf).select("attribute", "truth", out.alias("label_id")).groupBy("attribute", "truth", "label_id").agg(F.count("*").alias("n"))


def _sql_prompt_label(a: str, x: str) -> str:
    if a == "age":
        w = f"string_split(trim(coalesce({x}, '')), ' ')[1]"
        return f"CASE WHEN regexp_matches({w}, '^[+-]?\\d+$') THEN {_sql_age(f'CAST({w} AS INTEGER)')} ELSE '25-34' END"
    return _sql_cascade(f"lower(coalesce({x}, ''))", P.CASCADE_PROMPT[a])


_PL = "CASE " + " ".join(f"WHEN attribute = '{a}' THEN {_sql_prompt_label(a, 'truth')}" for a in P.ATTRIBUTES) + " END"


@query("flt06_prompt_label", f"WITH {GUESSES} SELECT attribute, truth, {_PL} AS label, count(*) AS n FROM guesses GROUP BY ALL")
def _(spark, sf):
    out = F.lit(None).cast("string")
    for a in P.ATTRIBUTES:
        out = F.when(F.col("attribute") == a, V.prompt_label(a, F.col("truth"))).otherwise(out)
    return guesses(spark, sf).select("attribute", "truth", out.alias("label")).groupBy("attribute", "truth", "label").agg(F.count("*").alias("n"))


_ATTACK = ", ".join(f"{_sql_cascade('lower(text)', (*P.ATTACK_LABELS[a], ('UNKNOWN', ())))} AS {a}" for a in P.ATTRIBUTES)


@query("str38_attack_labels", f"WITH {MESSAGES} SELECT conv_id, turn, {_ATTACK} FROM msg")
def _(spark, sf):
    x = V.attack_labels(F.col("text"))
    return messages(spark, sf).select("conv_id", "turn", *(x[a].alias(a) for a in P.ATTRIBUTES))


def _sql_markers(rules) -> str:
    import re

    return "CASE " + " ".join(f"WHEN {_rx('low', chr(92) + 'b(?:' + '|'.join(map(re.escape, m)) + ')' + chr(92) + 'b')} THEN {quoted(v)}" for v, m in rules) + " ELSE 'unknown' END"


def _sql_places() -> str:
    import re

    whens = []
    for city, m, code in P.ATTACK_PLACES:
        hit = _rx("low", rf"\b(?:{'|'.join(map(re.escape, m))})\b")
        if code:
            hit += " OR " + _rx("low", rf"[a-z][a-z .'-]*,\s*{code}(?:[^-\w]|$)")
        whens.append(f"WHEN {hit} THEN {quoted(city)}")
    return "CASE " + " ".join(whens) + " ELSE 'unknown' END"


_AGE_GUESS = f"""CASE WHEN try_cast(regexp_extract(low, {quoted(P.ATTACK_AGE)}, 1) AS INTEGER) > 10 THEN regexp_extract(low, {quoted(P.ATTACK_AGE)}, 1) || ' years old'
    WHEN contains(low, '20s') OR contains(low, 'twenties') THEN '20s' WHEN contains(low, 'college student') OR contains(low, 'freshman') THEN '18-22'
    WHEN contains(low, 'retired') OR contains(low, 'pension') THEN '65+' ELSE 'unknown' END"""


@query("str37_attack_guess", f"WITH {MESSAGES} SELECT conv_id, turn, {_AGE_GUESS} AS age, {_sql_places()} AS location, {_sql_markers(P.ATTACK_JOBS)} AS occupation, {_sql_markers(P.ATTACK_SCHOOLS)} AS education FROM (SELECT *, {LOW} AS low FROM msg)")
def _(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", *(V.attack_guess(F.col("text"), a).alias(a) for a in P.ATTRIBUTES))


# --- leakage over conversations ---

_CUM = ", ".join(
    f"round(greatest(0.0, least(1.0, CASE WHEN 1 - product(CASE WHEN {a} > 0.05 THEN 1 - {a} ELSE 1.0 END) OVER w = 0 THEN max({a}) OVER w ELSE 1 - product(CASE WHEN {a} > 0.05 THEN 1 - {a} ELSE 1.0 END) OVER w END)), 4) AS cum_{a}"
    for a in P.ATTRIBUTES
)
LEAK = f"""{_SCORES}, c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_number, {_CUM} FROM s WHERE role = 'user'
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    o AS (SELECT *, greatest(cum_age, cum_location, cum_occupation, cum_education) AS overall, round((1 - cum_age) + (1 - cum_location) + (1 - cum_occupation) + (1 - cum_education), 4) AS capacity FROM c),
    leak AS (SELECT *, round(overall - coalesce(lag(overall) OVER (PARTITION BY conv_id ORDER BY turn), 0), 4) AS delta, overall >= 0.60 OR capacity < 1.50 AS breached,
        CASE WHEN overall >= 0.60 THEN 'HIGH' WHEN overall >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM o)"""
_LEAK_COLUMNS = ["conv_id", "turn", "turn_number", *(f"cum_{a}" for a in P.ATTRIBUTES), "overall", "capacity", "delta", "breached", "band"]


def turn_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = V.rule_scores(F.col("text"))
    return messages(spark, sf).where("role = 'user'").select("conv_id", "turn", *(s[a].alias(a) for a in P.ATTRIBUTES))


@query("win01_05_leakage", f"WITH {LEAK} SELECT {', '.join(_LEAK_COLUMNS)} FROM leak")
def leakage(spark: SparkSession, sf: str) -> DataFrame:
    return L.cumulative_risk(turn_scores(spark, sf)).select(*_LEAK_COLUMNS)


@query(
    "win09_prefix_curve",
    f"""WITH {LEAK}, n AS (SELECT conv_id, max(turn_number) AS turns FROM leak GROUP BY conv_id),
        q AS (SELECT conv_id, unnest([1, 2, 4, 8]) AS requested, turns FROM n)
        SELECT q.conv_id, CAST(requested AS INTEGER) AS requested, CAST(least(requested, turns) AS INTEGER) AS used, overall FROM q JOIN leak ON leak.conv_id = q.conv_id AND leak.turn_number = least(requested, turns)""",
)
def _(spark, sf):
    out = L.prefix_curve(leakage(spark, sf))
    return out.select("conv_id", F.col("requested").cast("int"), F.col("used").cast("int"), "overall")


_TAX = ", ".join(f"{{'a': '{a}', 'l': {quoted(x)}, 'k': {len(ls)}}}" for a, ls in P.TAXONOMY.items() for x in ls)
_POST = f"""{MESSAGES}, g AS (SELECT conv_id, turn, {_ATTACK} FROM msg WHERE role = 'user'),
    t AS (SELECT unnest([{_TAX}]) AS x),
    d AS (SELECT conv_id, turn, x.a AS attribute, x.l AS label, x.k AS k, CASE x.a WHEN 'age' THEN age WHEN 'location' THEN location WHEN 'occupation' THEN occupation ELSE education END AS guess FROM g, t),
    lg AS (SELECT conv_id, turn, attribute, k, sum(CASE WHEN guess = 'UNKNOWN' THEN 0.0 ELSE 0.60 * ln((CASE WHEN guess = label THEN 0.60 ELSE 0.40::DOUBLE / (k - 1) END) * k) END)
        OVER (PARTITION BY conv_id, attribute, label ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp FROM d),
    e AS (SELECT conv_id, turn, attribute, k, exp(lp - max(lp) OVER (PARTITION BY conv_id, turn, attribute)) AS x FROM lg),
    ps AS (SELECT conv_id, turn, attribute, k, x / sum(x) OVER (PARTITION BY conv_id, turn, attribute) AS p FROM e),
    i AS (SELECT conv_id, turn, attribute, any_value(k) AS k, list_sort(list(p), 'DESC') AS r, -sum(p * ln(greatest(p, 1e-12))) / ln(any_value(k)) AS h FROM ps GROUP BY ALL),
    raw AS (SELECT conv_id, turn, attribute, greatest(0.0, least(1.0, greatest(0.0, (r[1] - 1.0 / k) / (1 - 1.0 / k)) * (0.5 * (1 - greatest(0.0, least(1.0, h))) + 0.5 * (r[1] - r[2])))) AS q FROM i),
    ui AS (SELECT conv_id, turn, attribute, round(CASE WHEN q < 0.30 THEN 0.30 * (q / 0.30) WHEN q < 0.60 THEN 0.30 + 0.30 * ((q - 0.30) / 0.30) ELSE 0.60 + 0.40 * ((q - 0.60) / 0.40) END, 4) AS s FROM raw),
    w AS (SELECT conv_id, turn, max(s) FILTER (WHERE attribute = 'age') AS age, max(s) FILTER (WHERE attribute = 'location') AS location, max(s) FILTER (WHERE attribute = 'occupation') AS occupation,
        max(s) FILTER (WHERE attribute = 'education') AS education, list_sort(list(s), 'DESC') AS r FROM ui GROUP BY ALL),
    m AS (SELECT *, max(round(sqrt((r[1] * r[1] + r[2] * r[2]) / 2), 4)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS leakage FROM w)"""


@query("win06_08_posterior_leakage", f"WITH {_POST} SELECT conv_id, turn, round(age, 3) AS age, round(location, 3) AS location, round(occupation, 3) AS occupation, round(education, 3) AS education, round(leakage, 3) AS leakage FROM m")
def _(spark, sf):
    x = V.attack_labels(F.col("text"))
    g = messages(spark, sf).where("role = 'user'").select("conv_id", "turn", *(x[a].alias(a) for a in P.ATTRIBUTES))
    out = L.label_leakage(g)
    return out.select("conv_id", "turn", *(F.round(c, 3).alias(c) for c in (*P.ATTRIBUTES, "leakage")))


@query(
    "win10_rank_attributes",
    f"""WITH {_SCORES}, l AS (SELECT conv_id, turn, unnest([{{'a': 'age', 's': age}}, {{'a': 'location', 's': location}}, {{'a': 'occupation', 's': occupation}}, {{'a': 'education', 's': education}}]) AS x FROM s),
        r AS (SELECT conv_id, turn, x.a AS a, x.s AS s, row_number() OVER (PARTITION BY conv_id, turn ORDER BY x.s DESC, x.a) AS k FROM l)
        SELECT conv_id, turn, max(a) FILTER (WHERE k = 1) AS top_attribute, coalesce(string_agg(a, ',' ORDER BY k) FILTER (WHERE k > 1 AND s >= 0.30), '') AS secondary FROM r GROUP BY ALL""",
)
def _(spark, sf):
    s = V.rule_scores(F.col("text"))
    entries = F.array(*(F.struct((-s[a]).alias("o"), F.lit(a).alias("a")) for a in P.ATTRIBUTES))
    rows = messages(spark, sf).select("conv_id", "turn", F.array_sort(entries).alias("r"))
    rest = F.transform(F.filter(F.slice("r", 2, 4), lambda x: -x["o"] >= P.MEDIUM_EDGE), lambda x: x["a"])
    return rows.select("conv_id", "turn", F.col("r")[0]["a"].alias("top_attribute"), F.array_join(rest, ",").alias("secondary"))


@query("win15_adjacent_pairs", """WITH p AS (SELECT conv_id, turn, role, sha256(text) AS t, lead(role) OVER w AS next_role, sha256(lead(text) OVER w) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, t AS user_text, n AS assistant_text FROM p WHERE role = 'user' AND next_role = 'assistant'""")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.sha2("text", 256).alias("user_text"), F.sha2("next", 256).alias("assistant_text"))


@query("agg33_repeated_pairs", """WITH p AS (SELECT role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    c AS (SELECT sha256(text) AS u, sha256(n) AS a, count(*) AS n FROM p WHERE role = 'user' AND next_role = 'assistant' GROUP BY ALL) SELECT u, a, n FROM c WHERE n > greatest(1, 0.01 * (SELECT sum(n) FROM c))""")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next"))
    pairs = rows.where("role = 'user' AND next_role = 'assistant'").groupBy(F.sha2("text", 256).alias("u"), F.sha2("next", 256).alias("a")).agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    return pairs.join(F.broadcast(total)).where(F.col("n") > F.greatest(F.lit(1), 0.01 * F.col("total"))).select("u", "a", "n")
