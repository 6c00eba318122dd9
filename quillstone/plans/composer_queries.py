"""Composed training examples and the check that targets tell nothing, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import composer as C
from quillstone.plans.inputs import MESSAGES, messages, quoted, read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def banks(spark: SparkSession, sf: str) -> DataFrame:
    """(attribute, surface, variants) from the names in the given tables."""
    t = lambda name: read(spark, sf, name)
    rows = [
        t("nation").select(F.lit("location").alias("attribute"), F.col("n_name").alias("surface")),
        t("customer").select(F.lit("occupation"), "c_mktsegment").distinct(),
        t("region").select(F.lit("education"), F.concat(F.lit("the University of "), "r_name")),
        t("supplier").select(F.lit("local_reference"), "s_name"),
        t("part").select(F.lit("age"), F.concat((F.col("p_size") + 18).cast("string"), F.lit("-year-old"))).distinct(),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.withColumn("variants", F.array(F.lower("surface")))


def carriers(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id") * 1000 + F.col("turn")
    param = F.when(c % 8 == 0, "occupation")
    return messages(spark, sf).where("role = 'user'").select(c.alias("carrier"), "text", F.when(c % 3 == 0, " the ").alias("split_hint"), (c % 4 == 0).alias("needs_persona"), param.alias("persona_param"))


def _draw(*slot: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '42', example, {', '.join(slot)})), 1, 8) AS BIGINT)"


def _one(drawn: str, n) -> str:
    return f"(({drawn}) * {n}) // 4294967296"


def _small(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\p{{Lu}}') AND NOT regexp_matches({x}, '^\\p{{Lu}}\\p{{Lu}}') THEN lower({x}[1]) || {x}[2:] ELSE {x} END"


def _told(frame: str) -> str:
    parts = re.split(r"\{(\w+?)([\^_]?)\}", frame)
    out = [quoted(parts[0])]
    for name, how, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        x = f'"{name}"'
        out += [f"upper({x}[1]) || {x}[2:]" if how == "^" else f"({_small(x)})" if how == "_" else x, quoted(rest)]
    return " || ".join(out)


def _choose(drawn: str, values) -> str:
    return f"CASE {_one(drawn, len(values))} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PHRASE = "contains(lower(text), lower({0})) AND regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape({0}) || '([^\\p{{L}}\\p{{N}}_]|$)')"
_FRAGMENT = "CASE attribute " + " ".join(f"WHEN '{a}' THEN " + _choose(_draw("slot", "try", "'fragment'"), [" || ".join([quoted(f.split("{v}")[0]), "surface", quoted(f.split("{v}")[1])]) for f in fs]) for a, fs in C.FRAGMENTS.items()) + " END"
_WEIGHTS = ", ".join(f"{{'a': '{a}', 'w': {w}::DOUBLE}}" for a, w in C.WEIGHTS.items())
_CLAUSE = "CASE WHEN len({0}) <= 1 THEN coalesce({0}[1], '') ELSE array_to_string({0}[1:len({0}) - 1], ', ') || ' and ' || {0}[-1] END"


def _part(i: int) -> str:
    cut = "rtrim(text[1:instr(text, hint) - 1])" if i == 1 else "ltrim(text[instr(text, hint) + length(hint):])"
    return f"CASE WHEN hint IS NOT NULL AND contains(text, hint) THEN {cut} " + " ".join(f"WHEN regexp_matches(text, {quoted(p)}) THEN regexp_extract(text, {quoted(p)}, {i})" for p in C.PARTS) + " END"


_DRAWN = _draw("'frame'")
_SQL = f"""WITH {MESSAGES}, raw AS (SELECT conv_id * 1000 + turn AS carrier, trim(text) AS text FROM msg WHERE role = 'user'),
    car AS (SELECT *, CASE WHEN carrier % 3 = 0 THEN ' the ' END AS hint, carrier % 4 = 0 AS needs, CASE WHEN carrier % 8 = 0 THEN 'occupation' END AS param, row_number() OVER (ORDER BY carrier, text) AS k FROM raw WHERE text <> ''),
    names AS (SELECT 'location' AS attribute, n_name AS surface FROM nation UNION ALL SELECT DISTINCT 'occupation', c_mktsegment FROM customer UNION ALL SELECT 'education', 'the University of ' || r_name FROM region
              UNION ALL SELECT 'local_reference', s_name FROM supplier UNION ALL SELECT DISTINCT 'age', (p_size + 18) || '-year-old' FROM part),
    bank AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY surface) AS k FROM names), size AS (SELECT attribute, max(k) AS n FROM bank GROUP BY attribute),
    base AS (SELECT c_custkey AS example, [{", ".join(map(quoted, C.POSITIONS))}][c_custkey % 5 + 1] AS asked FROM customer),
    plan AS (SELECT example, asked, {_one(_draw("'carrier'"), "(SELECT count(*) FROM car)")} + 1 AS k, {_draw("'noop'")} / 4294967296.0::DOUBLE < {C.NOOP} AS noop, {_draw("'many'")} / 4294967296.0::DOUBLE AS m FROM base),
    full_plan AS (SELECT plan.* EXCLUDE (k), carrier, text, hint, needs, param, greatest(CASE WHEN m < {C.ONE} THEN 1 WHEN m < {C.TWO} THEN 2 ELSE {C.FACTS} END, CASE WHEN asked = 'split' THEN 2 ELSE 1 END) AS many FROM plan JOIN car USING (k)),
    w AS (SELECT unnest([{_WEIGHTS}], recursive := true)), att AS (SELECT example, text, many, a AS attribute, n, -ln(({_draw("'attribute ' || a")} + 1) / 4294967296.0::DOUBLE) / w AS t FROM full_plan, w JOIN size ON size.attribute = w.a WHERE NOT noop),
    slots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example ORDER BY t, attribute) - 1 AS slot FROM att) WHERE slot < many),
    tried AS (SELECT *, {_one(_draw("slot", "try", "'fact'"), "n")} + 1 AS k FROM (SELECT *, unnest(range({C.TRIES})) AS try FROM slots)),
    fact AS (SELECT example, slot, attribute, surface, {_FRAGMENT} AS fragment FROM tried JOIN bank USING (attribute, k) WHERE NOT ({_PHRASE.format("surface")}) QUALIFY row_number() OVER (PARTITION BY example, slot ORDER BY try) = 1),
    facts AS (SELECT example, list(fragment ORDER BY slot) AS f, list(attribute ORDER BY slot) AS a, string_agg(surface, '|' ORDER BY slot) AS surfaces FROM fact GROUP BY example),
    rows AS (SELECT full_plan.*, coalesce(f, []) AS f, coalesce(a, []) AS a, coalesce(surfaces, '') AS surfaces, {_part(1)} AS head, {_part(2)} AS tail FROM full_plan LEFT JOIN facts USING (example)),
    placed AS (SELECT *, CASE WHEN len(f) = 0 THEN 'none' WHEN asked = 'mid_sentence' AND head IS NULL OR asked = 'split' AND len(f) < 2 THEN 'parenthetical' ELSE asked END AS position, text AS carrier_text,
               {_CLAUSE.format("f")} AS facts, coalesce(f[1], '') AS "first", {_CLAUSE.format("f[2:]")} AS others FROM rows),
    framed AS (SELECT * REPLACE (carrier AS carrier), CASE position {" ".join(f"WHEN '{p}' THEN " + _choose(_DRAWN, ["(SELECT " + _told(f).replace('"carrier"', "carrier_text") + ")" for f in C.FRAMES[p]]) for p in C.POSITIONS)} END AS framed,
               CASE position {" ".join(f"WHEN '{p}' THEN {_one(_DRAWN, len(C.FRAMES[p]))}" for p in C.POSITIONS)} ELSE -1 END AS frame FROM placed),
    clean AS (SELECT *, trim(regexp_replace(regexp_replace(framed, '\\s*([,;:])\\s*[,;:]', '\\1', 'g'), '\\s{{2,}}', ' ', 'g')) AS c FROM framed),
    made AS (SELECT example, carrier, position, CAST(frame AS BIGINT) AS frame, CASE WHEN position = 'none' THEN text ELSE upper(c[1]) || c[2:] END AS input, needs AND position <> 'none' AS needs_persona, array_to_string(a, ',') AS attributes, surfaces, text,
             coalesce(param, a[1], 'occupation') AS asked_for FROM clean),
    done AS (SELECT * EXCLUDE (text, asked_for), CASE WHEN needs_persona THEN 'For someone ' || (CASE asked_for {" ".join(f"WHEN '{a}' THEN " + _choose(_draw("'parameter'"), list(map(quoted, ps))) for a, ps in C.PARAMETERS.items())} END) || ': ' || text ELSE text END AS target FROM made)"""


def composed(spark: SparkSession, sf: str) -> DataFrame:
    examples = read(spark, sf, "customer").select(F.col("c_custkey").alias("example"))
    return C.composed(examples, carriers(spark, sf), banks(spark, sf))


@query("str42_composed", f"{_SQL} SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY input ORDER BY example) = 1")
def _(spark, sf):
    """An example for each customer, from the users' messages and the names in the tables."""
    joined = lambda name, by: F.array_join(F.transform("facts", lambda f: f[name]), by)
    return composed(spark, sf).select("example", "carrier", "position", "frame", "input", "target", "needs_persona", joined("attribute", ",").alias("attributes"), joined("surface", "|").alias("surfaces"))


@query("str42_position_counts", f"{_SQL}, kept AS (SELECT * FROM done QUALIFY row_number() OVER (PARTITION BY input ORDER BY example) = 1) SELECT position, frame, count(*) AS n FROM kept GROUP BY ALL")
def _(spark, sf):
    """How often each position and frame was taken; targets that leak are counted as position `leak` and there is none."""
    made = composed(spark, sf)
    counts = made.groupBy("position", "frame").agg(F.count("*").alias("n"))
    leaks = C.leaking(made).agg(F.count("*").alias("n")).where("n > 0").select(F.lit("leak").alias("position"), F.lit(0).cast("long").alias("frame"), "n")
    return counts.unionByName(leaks)
