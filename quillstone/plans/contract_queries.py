"""Contracts of records and configurations, and personal data at any depth, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import contracts as C
from quillstone.plans.inputs import MESSAGES, messages, quoted, read

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def _values(index: str, *json: str | None) -> str:
    """One JSON text after the other, by an index; None leaves the field out. Both engines read it."""
    return f"CASE ({index}) % {len(json)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else quoted(v)}" for i, v in enumerate(json)) + " END"


def _field(k: str, v: str) -> str:
    """A field of a JSON object, or nothing for a null expression."""
    return f"CASE WHEN ({v}) IS NULL THEN '' ELSE '\"{k}\":' || ({v}) || ',' END"


def _json(fields: dict[str, str]) -> str:
    return "'{' || " + " || ".join(_field(k, v) for k, v in fields.items()) + " || '\"end\":0}'"


_K, _C = "o_orderkey", "o_custkey"
_RECORD = _json({
    "participant_id": _values(_K, '"P07"', '"P123"', '"X7"', "7", "null", None, '"P12 "'), "scenario_id": _values(_C, '"S-01"', None, '"S-02"'), "experiment_id": _values(f"{_K} + 1", '"e1"', '"e1"', '"e2"', "null"),
    "session": _values(_C, "6", "6", "7", '"6"'), "date": _values(f"{_K} + {_C}", '"2026-04-10"', '"10/04/2026"', "20260410"), "system_state": _values(_K, '"rewrite_offered"', '"risk_negative_passthrough"', '"odd"', "null"),
    "rewrite_decision": _values(_C, '"accept_as_is"', '"accept_with_edits"', '"not_applicable"', '"later"', "null", "true"), "detected_risk": _values(f"{_K} + {_C}", "true", "false", '"true"', None, "1"),
    "rewrite_changed_text": _values(_C, "true", "false", "null"), "edit_made": _values(_K, "true", "false", None), "risk_score": _values(_C, "0", "1", "-0.25", "1.5", '"0.5"', "true", "null", "0.75"),
    "usefulness": _values(_K, "0", "10", "11", "-1", "[1]", "7.5"), "privacy_risk_delta": _values(_C, "-1", "0.25", "-1.25", None), "time_to_decision_seconds": _values(_K, "3.5", "-2", "0"),
    "anchors_available": _values(_C, '["age","city"]', '["age"]', "[]", "null", '"age"'), "anchors_used": _values(_K, '["city","age"]', '["job","age","city"]', "[]", None, "5"),
})
_RULES = (*C.RECORD_RULES, C.Equals("experiment_id", "e1"), C.Equals("session", 6))


class _Sql:
    """The conditions of the rules over JSON in DuckDB."""

    def kind(self, f: str) -> str:
        return f"coalesce(json_type(j, '$.{f}'), '')"

    def given(self, f: str) -> str:
        return f"{self.kind(f)} NOT IN ('', 'NULL')"

    def text(self, f: str) -> str:
        return f"json_extract_string(j, '$.{f}')"

    def texts(self, f: str) -> str:
        return f"CASE WHEN {self.kind(f)} = 'ARRAY' THEN CAST(json_extract(j, '$.{f}') AS VARCHAR[]) END"

    def numeric(self, f: str) -> str:
        return f"{self.kind(f)} IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"

    def problems(self, rule):
        f = getattr(rule, "field", None)
        if isinstance(rule, C.Required):
            yield f"{self.kind(f)} = ''", quoted(f"missing required field '{f}'")
        elif isinstance(rule, C.Text):
            yield f"{self.given(f)} AND {self.kind(f)} <> 'VARCHAR'", quoted(f"{f} must be a string")
            if rule.pattern:
                yield f"{self.kind(f)} = 'VARCHAR' AND NOT regexp_full_match({self.text(f)}, {quoted(rule.pattern)})", f"{quoted(f + ' ' + chr(39))} || {self.text(f)} || {quoted(chr(39) + f' does not match ' + chr(39) + rule.pattern + chr(39))}"
            if rule.filled:
                yield f"{self.kind(f)} = 'VARCHAR' AND trim({self.text(f)}) = ''", quoted(f"{f} must not be empty")
        elif isinstance(rule, C.OneOf):
            yield f"{self.given(f)} AND {self.text(f)} NOT IN ({', '.join(map(quoted, rule.values))})", f"{quoted(f + ' ' + chr(39))} || {self.text(f)} || {quoted(chr(39) + ' is not one of ' + ', '.join(sorted(rule.values)))}"
        elif isinstance(rule, C.Equals):
            yield f"{self.given(f)} AND {self.text(f)} <> '{rule.value}'", f"'{f} mismatch: ' || {self.text(f)} || ' is not {rule.value}'"
        elif isinstance(rule, C.Flag):
            yield f"{self.given(f)} AND {self.kind(f)} <> 'BOOLEAN'", f"'{f} must be boolean'"
        elif isinstance(rule, C.Number):
            x = f"CASE WHEN {self.numeric(f)} THEN CAST({self.text(f)} AS DOUBLE) END"
            outside = " OR ".join([f"({x}) < {rule.low}" if rule.low is not None else "false", f"({x}) > {rule.high}" if rule.high is not None else "false"])
            yield f"{self.given(f)} AND NOT {self.numeric(f)}", f"'{f} must be numeric'"
            yield outside, f"'{f} is outside [{'' if rule.low is None else f'{rule.low:g}'}, {'' if rule.high is None else f'{rule.high:g}'}]'"
        elif isinstance(rule, C.Subset):
            for name in (f, rule.of):
                yield f"{self.given(name)} AND {self.kind(name)} <> 'ARRAY'", f"'{name} must be a list'"
            unknown = f"list_sort(list_filter(list_distinct({self.texts(f)}), lambda x: NOT list_contains({self.texts(rule.of)}, x)))"
            yield f"len({unknown}) > 0", f"'{f} not in {rule.of}: ' || array_to_string({unknown}, ', ')"


_NEVER = {
    "risk_negative_passthrough cannot have detected_risk": "json_extract_string(j, '$.system_state') = 'risk_negative_passthrough' AND (json_extract_string(j, '$.detected_risk') IN ('true', '1'))",
    "risk_negative_passthrough cannot have rewrite_changed_text": "json_extract_string(j, '$.system_state') = 'risk_negative_passthrough' AND json_extract_string(j, '$.rewrite_changed_text') = 'true'",
    "risk_negative_passthrough needs rewrite_decision not_applicable": "json_extract_string(j, '$.system_state') = 'risk_negative_passthrough' AND json_extract_string(j, '$.rewrite_decision') <> 'not_applicable'",
    "accept_with_edits needs edit_made": "json_extract_string(j, '$.rewrite_decision') = 'accept_with_edits' AND NOT coalesce(json_extract_string(j, '$.edit_made') = 'true', false)",
    "user_study section is required for user_evaluation": "json_extract_string(j, '$.experiment_type') = 'user_evaluation' AND coalesce(json_type(j, '$.user_study'), '') <> 'OBJECT'",
    "user_study.core_scenarios cannot be empty": "json_type(j, '$.user_study') = 'OBJECT' AND coalesce(json_array_length(j, '$.user_study.core_scenarios'), 0) = 0",
    "scenario ids appear more than once": "len(list_distinct(coalesce(CAST(json_extract(j, '$.user_study.core_scenarios') AS VARCHAR[]), []) || coalesce(CAST(json_extract(j, '$.user_study.optional_scenarios') AS VARCHAR[]), []))) < len(coalesce(CAST(json_extract(j, '$.user_study.core_scenarios') AS VARCHAR[]), []) || coalesce(CAST(json_extract(j, '$.user_study.optional_scenarios') AS VARCHAR[]), []))",
    "dataset revision is still TBD": "json_extract_string(j, '$.dataset.revision') = 'TBD'",
    "rewriter checkpoint is still TBD": "json_extract_string(j, '$.rewriter.checkpoint') = 'TBD'",
}


def _checked(rules) -> str:
    s = _Sql()
    found = [x for r in rules for x in ([(_NEVER[r.words], quoted(r.words))] if isinstance(r, C.Never) else s.problems(r))]
    return "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN {words} END" for bad, words in found) + "], lambda x: x IS NOT NULL)"


@query("flt12_record_contract", f"WITH r AS (SELECT o_orderkey AS id, CAST({_RECORD} AS JSON) AS j FROM orders), e AS (SELECT id, {_checked(_RULES)} AS e FROM r) SELECT id, unnest(e) AS error FROM e")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that is wrong with study records of mixed types, one row an error."""
    rows = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"parse_json({_RECORD}) AS record")
    return rows.select("id", F.explode(C.errors(F.col("record"), _RULES)).alias("error"))


_S = "o_orderkey"
_CONFIG = _json({
    "experiment_id": _values(_S, '"e1"', '" "', "5", None), "session": _values(_C, "6", "0", '"6"', None, "-1"), "experiment_type": _values(_S, '"user_evaluation"', '"other"', None), "random_seed": _values(_C, "42", None),
    "metrics": _values(_C, "[]", "{}", None), "output": "'{}'", "validation": "'{}'", "dataset": _values(_C, '{"revision":"TBD"}', '{"revision":"abc"}', "[]"), "rewriter": _values(_S, '{"checkpoint":"TBD"}', None, "{}"),
    "user_study": _values(f"{_S} + {_C}", '{"core_scenarios":["a","b"],"optional_scenarios":["c"]}', '{"core_scenarios":["a"],"optional_scenarios":["a"]}', '{"core_scenarios":[]}', "{}", None, "5"),
})


@query("flt13_config_contract", f"WITH r AS (SELECT o_orderkey AS id, CAST({_CONFIG} AS JSON) AS j FROM orders), e AS (SELECT id, {_checked(C.CONFIG_RULES)} AS e FROM r) SELECT id, unnest(e) AS error FROM e")
def _(spark, sf):
    rows = read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"parse_json({_CONFIG}) AS config")
    return rows.select("id", F.explode(C.errors(F.col("config"), C.CONFIG_RULES)).alias("error"))


def _nested(spark, sf) -> DataFrame:
    """Messages five levels deep, beside other texts, numbers and nulls."""
    m = messages(spark, sf)
    inner = F.struct(F.col("text").alias("body"), F.col("turn").alias("n"), F.array(F.create_map(F.lit("again"), F.col("other"), F.lit("role"), F.col("role"))).alias("more"))
    value = F.struct(F.array(F.struct(F.create_map(F.lit("a"), F.array(inner), F.lit("none"), F.lit(None)).alias("parts"), F.lit("call 555-123-4567").alias("note")), F.lit(None)).alias("list"), F.col("role").alias("role"))
    return m.select("conv_id", "turn", value.alias("value"))


_HITS = "SELECT conv_id, turn, path, finding FROM (SELECT conv_id, turn, path, unnest([CASE WHEN regexp_matches(t, {0}) THEN 'possible email address' END, CASE WHEN regexp_matches(t, {1}) THEN 'possible phone number' END]) AS finding FROM p) WHERE finding IS NOT NULL"
_PLAIN_TEXT = "regexp_replace({}, '[À-ÖØ-öø-ÿß]', 'x', 'g')"
_PATHS = f"""WITH {MESSAGES}, p AS (SELECT conv_id, turn, 'list[0].parts{{a}}[0].body' AS path, {_PLAIN_TEXT.format('text')} AS t FROM msg UNION ALL SELECT conv_id, turn, 'list[0].parts{{a}}[0].more[0]{{again}}', {_PLAIN_TEXT.format('other')} FROM msg
    UNION ALL SELECT conv_id, turn, 'list[0].note', 'call 555-123-4567' FROM msg) {_HITS.format(quoted(C.P.EMAIL), quoted(C.P.PHONE))}"""


@query("flt14_deep_findings", _PATHS)
def _(spark, sf):
    """Personal data in nested messages, with the path of every hit."""
    return C.findings(_nested(spark, sf), ["conv_id", "turn"], "value")


@query("flt14_walked_findings", _PATHS.replace("{a}", ".a").replace("{again}", ".again"))
def _(spark, sf):
    """The same from VARIANT values, whose shape nobody declares."""
    rows = _nested(spark, sf).select(F.struct("conv_id", "turn").alias("id"), F.parse_json(F.to_json("value")).alias("v"))
    found = C.walked(rows, "id", "v")
    hits = F.array_compact(F.array(*(F.when(C.matches(F.col("text"), p), name) for name, p in C.FINDINGS.items())))
    return found.select("id.conv_id", "id.turn", "path", F.explode(hits).alias("finding"))
