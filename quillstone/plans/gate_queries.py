"""Attack success over text variants, split manifests and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.operators import contracts as C
from quillstone.operators import evaluation as E
from quillstone.plans.contract_queries import _Sql, _json, _values
from quillstone.plans.inputs import MESSAGES, messages, quoted, read
from quillstone.plans.privacy_queries import _INDIRECT, _REDACT, _TYPES, _sql_cascade, _sql_chain
from quillstone.sources import manifest
from quillstone.sources.tables import shared_folder

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


# -- attacks on variants -------------------------------------------------------------------------------------------

VARIANTS = ("raw", "redacted", "rewritten")


def _label(text: str, a: str) -> str:
    return _sql_cascade(f"lower({text})", (*P.ATTACK_LABELS[a], ("UNKNOWN", ())))


_EACH = ", ".join(f"{{'attribute': '{a}', 'variant': '{v}', 'truth': {_label('both_texts', a)}, 'guess': {_label(v, a)}}}" for v in VARIANTS for a in P.ATTRIBUTES)
_HITS = f"""{MESSAGES}, tx AS (SELECT *, text || ' ' || other AS both_texts, text AS raw, {_REDACT} AS redacted, {_sql_chain('text', P.PLACEHOLDERS)} AS rewritten, len({_TYPES}) > 0 AS e, ({_INDIRECT}) AS i FROM msg WHERE role = 'user'),
    ea AS (SELECT conv_id, turn, CASE WHEN e AND i THEN 'complicated' WHEN e THEN 'direct' WHEN i THEN 'indirect' ELSE 'direct' END AS hardness, unnest([{_EACH}]) AS x FROM tx),
    hit AS (SELECT hardness, x.attribute AS attribute, x.variant AS variant, x.guess = x.truth AS hit FROM ea WHERE x.truth <> 'UNKNOWN')"""


def attacked(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of the label attacker on each user's message as it is, redacted and rewritten; what it finds in the message and
    its neighbour together is the truth."""
    rows = messages(spark, sf).where("role = 'user'")
    rows = rows.select("text", F.concat("text", F.lit(" "), "other").alias("both"), V.redacted(F.col("text")).alias("redacted"), V.placeholders(F.col("text")).alias("rewritten"), V.hardness(F.col("text")).alias("hardness"))
    return E.hits(rows, ["hardness"], {"raw": "text", "redacted": "redacted", "rewritten": "rewritten"}, V.attack_labels(F.col("both")), V.attack_labels)


@query("agg16_attack_by_hardness", f"""WITH {_HITS}, r AS (SELECT hardness, variant, count(*) AS n, avg(hit::INT) AS asr FROM hit GROUP BY ALL),
    d AS (SELECT h AS hardness, v AS variant FROM (SELECT unnest(['direct', 'indirect', 'complicated']) AS h), (SELECT unnest(['raw', 'redacted', 'rewritten']) AS v))
    SELECT d.hardness, d.variant, coalesce(r.n, 0) AS n, round(r.asr, 4) AS asr, round(b.asr - r.asr, 4) AS reduction FROM d LEFT JOIN r ON r.hardness = d.hardness AND r.variant = d.variant LEFT JOIN r b ON b.hardness = d.hardness AND b.variant = 'raw'""")
def _(spark, sf):
    return E.by_hardness(attacked(spark, sf), list(VARIANTS))


_DELTAS = f"""{_HITS}, w AS (SELECT coalesce(attribute, 'all') AS attribute, count(*) FILTER (WHERE variant = 'raw') AS n, avg(hit::INT) FILTER (WHERE variant = 'raw') AS a, avg(hit::INT) FILTER (WHERE variant = 'redacted') AS b, avg(hit::INT) FILTER (WHERE variant = 'rewritten') AS c
    FROM hit GROUP BY ROLLUP (attribute)), dl AS (SELECT attribute, n, round(a, 4) AS raw, round(b, 4) AS baseline, round(c, 4) AS student, round(b - c, 4) AS delta FROM w)"""


@query("agg19_student_deltas", f"WITH {_DELTAS} SELECT * FROM dl")
def _(spark, sf):
    return E.deltas(attacked(spark, sf), *VARIANTS)


def _percent(x: str) -> str:
    return f"CAST(CAST(round({x} * 10000) AS BIGINT) AS VARCHAR)"


_CELLS = ["attribute", "n", "raw", "baseline", "student", "delta"]
_LINE = "'| ' || attribute || ' | ' || n || ' | ' || " + " || ' | ' || ".join(map(_percent, _CELLS[2:])) + " || ' |'"


@query("snk06_comparison_matrix", f"WITH {_DELTAS} SELECT 0 AS line, {quoted('| ' + ' | '.join(_CELLS) + ' |')} AS markdown UNION ALL SELECT 1, {quoted('|' + '-|' * len(_CELLS))} UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY attribute) AS INTEGER), {_LINE} FROM dl")
def _(spark, sf):
    """The comparison of raw, redacted and rewritten messages as Markdown; rates are in parts of ten thousand."""
    parts = lambda c: F.round(F.col(c) * 10000).cast("long").alias(c)
    return E.matrix(E.deltas(attacked(spark, sf), *VARIANTS).select("attribute", "n", *map(parts, _CELLS[2:])), _CELLS)


# -- manifests and gates -------------------------------------------------------------------------------------------

_SPLITS = "CASE WHEN conv_id % 10 < 7 THEN 'train' WHEN conv_id % 10 < 9 THEN 'val' ELSE 'test' END"


def _written(spark: SparkSession, sf: str) -> str:
    path = shared_folder(spark)
    manifest.write(read(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "text", f"{_SPLITS} AS split").repartition(3), path)
    return path


@query("snk01_split_manifest", f"SELECT {_SPLITS} AS split, count(*) AS rows, 'READY' AS gate FROM conversations GROUP BY ALL")
def _(spark, sf):
    """Splits of the conversations as JSON lines; every file's digest and rows are as the manifest says."""
    return manifest.gates(spark, _written(spark, sf)).select("split", "rows", "gate")


@query("src10_listed_split", f"SELECT role, count(*) AS n, sum(length(text)) AS characters FROM conversations WHERE {_SPLITS} = 'train' GROUP BY role")
def _(spark, sf):
    """The records of a verified split of many files."""
    rows = manifest.read(spark, _written(spark, sf), "train", "conv_id long, turn long, role string, text string", seed=42)
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


@query("agg38_artifact_gate", f"SELECT {_SPLITS} AS split, CASE WHEN {_SPLITS} = 'val' THEN 'BLOCKED' ELSE 'READY' END AS gate FROM conversations GROUP BY ALL")
def _(spark, sf):
    """The gate after someone has added a record to one split."""
    path = _written(spark, sf)
    read(spark, sf, "conversations").limit(1).select("text").coalesce(1).write.mode("append").json(f"{path}/data/split=val")
    return manifest.gates(spark, path).select("split", "gate")


_K, _C = "o_orderkey", "o_custkey"
_REPORT = _json({
    "dataset_revision": _values(_K, '"r1"', '"r2"', '"r1"', None), "split_name": _values(_C, '"val"', '"val"', '"test"'), "split_manifest_sha256": _values(_K, '"abc"', '"abc"', '""'),
    "adversary": _values(_C, '{"model":"held-out","mode":"model","held_out":true,"probes":12}', '{"model":"held-out","mode":"heuristic","held_out":true,"probes":12}', '{"model":"held-out","mode":"model","held_out":true,"probes":0}', '{"model":"held-out","mode":"model","held_out":true,"probes":5}', "[]"),
    "utility": _values(_K, '{"backend":"model","share":1}', '{"backend":"lexical","share":0.5}', '{"backend":"model","share":0.25}'),
})
#: What a headline claim needs, and what a claim of utility needs besides.
_PRIVACY = (C.Required("dataset_revision"), C.Equals("dataset_revision", "r1"), C.Equals("split_name", "val"), C.Text("split_manifest_sha256", filled=True), C.Required("adversary.model"), C.Equals("adversary.model", "held-out"), C.Equals("adversary.mode", "model"), C.Flag("adversary.held_out"), C.Number("adversary.probes", 1))
_UTILITY = (C.Equals("utility.backend", "model"), C.Number("utility.share", 0.5, 1))


def _problems(rules) -> str:
    found = [x for r in rules for x in _Sql().problems(r)]
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN {words} END" for bad, words in found) + "], lambda x: x IS NOT NULL)"


@query("agg37_report_gate", f"""WITH r AS (SELECT o_orderkey AS id, CAST({_REPORT} AS JSON) AS j FROM orders), e AS (SELECT id, {_problems(_PRIVACY)} AS h, {_problems(_UTILITY)} AS s FROM r)
    SELECT id, CASE WHEN len(h) > 0 THEN 'BLOCKED' WHEN len(s) > 0 THEN 'DIAGNOSTIC_ONLY' ELSE 'PASS' END AS status, array_to_string(h || s, '; ') AS reasons FROM e""")
def _(spark, sf):
    """Reports of evaluations against what a claim needs: provenance blocks, a weak measure of utility only diagnoses."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"parse_json({_REPORT}) AS report")
    return rows.select("id", E.gate(F.col("report"), _PRIVACY, _UTILITY).alias("g")).select("id", "g.status", F.array_join("g.reasons", "; ").alias("reasons"))
