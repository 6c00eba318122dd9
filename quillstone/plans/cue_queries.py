"""Queries of cues: attributions of tokens, and cues verified by masking, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.operators import cues as C
from quillstone.plans.inputs import MESSAGES, messages, quoted
from quillstone.plans.privacy_queries import LOW, _sql_scores

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("arr06_token_cues")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of each message, from pieces of up to four letters whose attribution is their share of vowels less a quarter; two
    capitalised words in a row are an entity."""
    pieces = F.transform(C.places(F.col("text"), r"(?U)\w{1,4}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (F.regexp_count(x["surface"], F.lit("[AEIOUaeiou]")) / 4.0 - 0.25).alias("score")))
    entities = F.transform(C.places(F.col("text"), r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    rows = messages(spark, sf).select("conv_id", "turn", "text", pieces.alias("pieces"), entities.alias("entities"))
    found = rows.select("conv_id", "turn", F.posexplode(C.token_cues(F.col("text"), F.col("pieces"), F.col("entities"))).alias("place", "c"))
    return found.select("conv_id", "turn", "place", "c.surface", "c.start", "c.end", "c.importance")


_FALLBACK = [(a, k) for a, ks in P.FALLBACK_CUES.items() for k in ks]
_KEYS = ", ".join(f"{{'a': '{a}', 'k': {quoted(k)}, 'i': {i}}}" for i, (a, k) in enumerate(_FALLBACK))
_VERIFIED = f"""WITH {MESSAGES}, k AS (SELECT unnest([{_KEYS}]) AS x),
    c AS (SELECT conv_id, turn, text, x.i AS i, x.a AS attribute, instr(lower(text), x.k) - 1 AS start, instr(lower(text), x.k) - 1 + length(x.k) AS stop, least(1.0, length(x.k) / 10.0::DOUBLE) AS share FROM msg, k WHERE contains(lower(text), x.k)),
    six AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn, attribute ORDER BY i) <= 6),
    v AS (SELECT conv_id, turn, i, attribute, start, stop, share, text[start + 1:stop] AS surface, text[1:start] || '[MASK]' || text[stop + 1:] AS text FROM six),
    after AS (SELECT *, {_sql_scores()} FROM (SELECT *, {LOW} AS low FROM v)), before AS (SELECT conv_id, turn, {_sql_scores()} FROM (SELECT *, {LOW} AS low FROM msg)),
    d AS (SELECT a.conv_id, a.turn, a.i, a.attribute, a.start, a.stop, a.surface, a.share, CASE a.attribute {" ".join(f"WHEN '{a}' THEN b.{a}" for a in P.ATTRIBUTES)} END AS base, CASE a.attribute {" ".join(f"WHEN '{a}' THEN a.{a}" for a in P.ATTRIBUTES)} END AS left_over
          FROM after a JOIN before b USING (conv_id, turn)),
    m AS (SELECT *, greatest(0.0, base - left_over) AS fall, least(1.0, 0.55 * share + 0.45 * least(1.0, greatest(0.0, base - left_over) / greatest(base, 0.1))) AS weight FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, attribute ORDER BY weight DESC, i) AS rank FROM m WHERE weight >= 0.15)
    SELECT conv_id, turn, attribute, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", surface, round(fall, 4) AS "drop", round(weight, 4) AS importance FROM r WHERE rank <= 3"""


@query("top04_verified_cues", _VERIFIED)
def _(spark, sf):
    """Keyword cues of each message, whose share is their length by ten, verified by masking under the rule scores."""
    low = F.lower("text")
    cue = lambda a, k: F.struct(F.lit(a).alias("attribute"), (F.instr(low, k) - 1).alias("start"), (F.instr(low, k) - 1 + len(k)).alias("end"), F.lit(min(1.0, len(k) / 10)).alias("share"))
    found = F.filter(F.array(*(cue(a, k) for a, k in _FALLBACK)), lambda c: c["start"] >= 0)
    rows = messages(spark, sf).select("conv_id", "turn", "text", found.alias("found"))
    return C.verified(rows, ["conv_id", "turn"], "text", "found", V.rule_scores)
