"""Contracts of records and configurations: declared rules become one expression that lists what is wrong.

Records are VARIANT values, as JSON of mixed types is read: a field's type is a thing to check and not an error of the
reader. A rule is a few conditions with their words; all rules of a contract are one array in one projection, so a
contract costs one pass whatever its size, and a configuration is checked as a table of one row.

Also here: every text in a value of any depth, with its path, over a schema or over VARIANT values of unknown shape.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import patterns as P
from quillstone.functions.text import matches


class Record:
    """Fields of a VARIANT record as columns; a field may be a dotted path."""

    def __init__(self, value: Column):
        self.value = value

    def field(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "variant")

    def missing(self, name: str) -> Column:
        return self.field(name).isNull()

    def given(self, name: str) -> Column:
        """Neither missing nor null."""
        return self.field(name).isNotNull() & ~F.is_variant_null(self.field(name))

    def kind(self, name: str) -> Column:
        return F.regexp_extract(F.coalesce(F.schema_of_variant(self.field(name)), F.lit("")), r"^\w*", 0)

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "string")

    def number(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "double")

    def flag(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "boolean")

    def texts(self, name: str) -> Column:
        return F.try_variant_get(self.value, f"$.{name}", "array<string>")

    def numeric(self, name: str) -> Column:
        return self.kind(name).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


Problem = tuple[Column, Column | str]


@dataclass(frozen=True)
class Required:
    field: str

    def problems(self, r: Record) -> Iterator[Problem]:
        yield r.missing(self.field), f"missing required field '{self.field}'"


@dataclass(frozen=True)
class Text:
    """A string; with a pattern, one that it matches as a whole; with filled, one that is not blank."""

    field: str
    pattern: str | None = None
    filled: bool = False

    def problems(self, r: Record) -> Iterator[Problem]:
        is_text = r.kind(self.field) == "STRING"
        yield r.given(self.field) & ~is_text, f"{self.field} must be a string"
        if self.pattern is not None:
            yield r.given(self.field) & is_text & ~F.coalesce(r.text(self.field).rlike(rf"\A(?:{self.pattern})\z"), F.lit(False)), F.concat(F.lit(f"{self.field} '"), r.text(self.field), F.lit(f"' does not match '{self.pattern}'"))
        if self.filled:
            yield is_text & (F.trim(r.text(self.field)) == ""), f"{self.field} must not be empty"


@dataclass(frozen=True)
class OneOf:
    field: str
    values: tuple[str, ...]

    def problems(self, r: Record) -> Iterator[Problem]:
        yield r.given(self.field) & ~F.coalesce(r.text(self.field).isin(*self.values), F.lit(False)), F.concat(F.lit(f"{self.field} '"), F.coalesce(r.text(self.field), F.lit("")), F.lit("' is not one of " + ", ".join(sorted(self.values))))


@dataclass(frozen=True)
class Equals:
    field: str
    value: str | int

    def problems(self, r: Record) -> Iterator[Problem]:
        yield r.given(self.field) & ~r.text(self.field).eqNullSafe(F.lit(str(self.value))), F.concat(F.lit(f"{self.field} mismatch: "), F.coalesce(r.text(self.field), F.lit("")), F.lit(f" is not {self.value}"))


@dataclass(frozen=True)
class Flag:
    field: str

    def problems(self, r: Record) -> Iterator[Problem]:
        yield r.given(self.field) & (r.kind(self.field) != "BOOLEAN"), f"{self.field} must be boolean"


@dataclass(frozen=True)
class Number:
    """A number; booleans and numbers in strings are none."""

    field: str
    low: float | None = None
    high: float | None = None

    def problems(self, r: Record) -> Iterator[Problem]:
        yield r.given(self.field) & ~r.numeric(self.field), f"{self.field} must be numeric"
        x = r.number(self.field)
        outside = F.lit(False)
        for edge, beyond in ((self.low, lambda e: x < e), (self.high, lambda e: x > e)):
            if edge is not None:
                outside = outside | beyond(edge)
        yield r.numeric(self.field) & outside, f"{self.field} is outside [{'' if self.low is None else f'{self.low:g}'}, {'' if self.high is None else f'{self.high:g}'}]"


@dataclass(frozen=True)
class Subset:
    """A list of strings, each of them in another list of the record."""

    field: str
    of: str

    def problems(self, r: Record) -> Iterator[Problem]:
        for name in (self.field, self.of):
            yield r.given(name) & (r.kind(name) != "ARRAY"), f"{name} must be a list"
        unknown = F.array_sort(F.array_except(r.texts(self.field), r.texts(self.of)))
        yield F.coalesce(F.size(unknown) > 0, F.lit(False)), F.concat(F.lit(f"{self.field} not in {self.of}: "), F.array_join(unknown, ", ", "null"))


@dataclass(frozen=True)
class Never:
    """Fields that must not be as they are together."""

    bad: Callable[[Record], Column]
    words: str

    def problems(self, r: Record) -> Iterator[Problem]:
        yield F.coalesce(self.bad(r), F.lit(False)), self.words


def errors(record: Column, rules) -> Column:
    """array of what is wrong with a VARIANT record, in the order of the rules. A null record (no JSON) is one error."""
    r = Record(record)
    found = [F.when(F.coalesce(bad, F.lit(False)), words if isinstance(words, Column) else F.lit(words)) for rule in rules for bad, words in rule.problems(r)]
    return F.when(record.isNull(), F.array(F.lit("not a JSON record"))).otherwise(F.array_compact(F.array(*found)))


def config_errors(spark: SparkSession, config, rules) -> list[str]:
    """What is wrong with one configuration (what JSON can hold), as a list."""
    row = spark.createDataFrame([(json.dumps(config),)], "j string")
    return row.select(errors(F.try_parse_json("j"), rules).alias("e")).first()["e"]


STATES = ("risk_negative_passthrough", "rewrite_offered", "rewrite_failed", "warning_only", "blocked")
DECISIONS = ("accept_as_is", "accept_with_edits", "reject", "not_applicable")
#: The study's record contract.
RECORD_RULES = (
    *map(Required, ("participant_id", "scenario_id", "experiment_id", "session", "date", "system_state")),
    Text("participant_id", r"P\d{2,}"), Text("date", r"\d{4}-\d{2}-\d{2}"), OneOf("system_state", STATES), OneOf("rewrite_decision", DECISIONS),
    *map(Flag, ("detected_risk", "requested_rewrite", "rewrite_changed_text", "edit_made", "would_use_before_sending", "protocol_deviation", "evaluator_intervention_pre_submit")),
    *(Number(f, 0, 1) for f in ("risk_score", "risk_before", "risk_after", "utility_score", "cosine_similarity", "contradiction")),
    Number("privacy_risk_delta", -1, 1), Number("usefulness", 0, 10), Number("time_to_decision_seconds", 0), Number("query_formulation_seconds", 0),
    Subset("anchors_used", "anchors_available"),
    Never(lambda r: (r.text("system_state") == STATES[0]) & r.flag("detected_risk"), f"{STATES[0]} cannot have detected_risk"),
    Never(lambda r: (r.text("system_state") == STATES[0]) & r.flag("rewrite_changed_text"), f"{STATES[0]} cannot have rewrite_changed_text"),
    Never(lambda r: (r.text("system_state") == STATES[0]) & (r.text("rewrite_decision") != "not_applicable"), f"{STATES[0]} needs rewrite_decision not_applicable"),
    Never(lambda r: (r.text("rewrite_decision") == "accept_with_edits") & ~F.coalesce(r.flag("edit_made"), F.lit(False)), "accept_with_edits needs edit_made"),
)
#: The contract of an experiment's configuration.
CONFIG_RULES = (
    *map(Required, ("experiment_id", "experiment_type", "metrics", "output", "random_seed", "session", "validation")),
    Text("experiment_id", filled=True), Number("session", 1),
    Never(lambda r: (r.text("experiment_type") == "user_evaluation") & (r.kind("user_study") != "OBJECT"), "user_study section is required for user_evaluation"),
    Never(lambda r: (r.kind("user_study") == "OBJECT") & (F.size(F.coalesce(r.texts("user_study.core_scenarios"), F.array().cast("array<string>"))) == 0), "user_study.core_scenarios cannot be empty"),
    Never(lambda r: F.size(F.array_distinct(_scenarios(r))) < F.size(_scenarios(r)), "scenario ids appear more than once"),
    Never(lambda r: r.text("dataset.revision") == "TBD", "dataset revision is still TBD"),
    Never(lambda r: r.text("rewriter.checkpoint") == "TBD", "rewriter checkpoint is still TBD"),
)


def _scenarios(r: Record) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(r.texts("user_study.core_scenarios"), none), F.coalesce(r.texts("user_study.optional_scenarios"), none))


# -- texts at any depth --------------------------------------------------------------------------------------------

_LEAF = "array<struct<path:string,text:string>>"


def leaves(value: Column, kind: T.DataType, path: Column | str = "") -> Column:
    """array<struct<path,text>> of every string in a typed value: the walk goes over the type, so it is one expression.
    Fields are named, elements numbered from 0, map values named by their keys; keys are no texts. Nulls have none."""
    at = F.lit(path) if isinstance(path, str) else path
    none = F.expr(f"cast(array() as {_LEAF})")
    if isinstance(kind, T.StringType):
        return F.when(value.isNotNull(), F.array(F.struct(at.alias("path"), value.alias("text")))).otherwise(none)
    if isinstance(kind, T.StructType):
        dot = F.when(at == "", "").otherwise(F.concat(at, F.lit(".")))
        parts = [leaves(value[f.name], f.dataType, F.concat(dot, F.lit(f.name))) for f in kind.fields if _has_text(f.dataType)]
        return F.concat(*parts) if parts else none
    if isinstance(kind, T.ArrayType) and _has_text(kind.elementType):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if isinstance(kind, T.MapType) and _has_text(kind.valueType):
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, F.concat(at, F.lit("{"), e["key"].cast("string"), F.lit("}"))))), none)
    return none


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType) or isinstance(kind, T.ArrayType) and _has_text(kind.elementType) or isinstance(kind, T.MapType) and _has_text(kind.valueType)


FINDINGS = {"possible email address": P.EMAIL, "possible phone number": P.PHONE}


def findings(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, path, finding): texts of a typed column, at any depth, that may hold personal data, with where they are."""
    texts = rows.select(*keys, F.explode(leaves(F.col(value), rows.schema[value].dataType)).alias("leaf")).select(*keys, "leaf.path", "leaf.text")
    hits = F.array_compact(F.array(*(F.when(matches(F.col("text"), p), name) for name, p in FINDINGS.items())))
    return texts.select(*keys, "path", F.explode(hits).alias("finding"))


def walked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, text) of every string in VARIANT values of any shape: a level at a time, until no container is left. The
    number of rounds is the depth of the deepest value."""
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.col(value).alias("v"))
    kind = F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("")), r"^\w*", 0)
    out = None
    while True:
        texts = level.where(kind == "STRING").select("key", "path", F.try_variant_get("v", "$", "string").alias("text"))
        out = texts if out is None else out.unionByName(texts)
        inner = level.where(kind.isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            return out.withColumnRenamed("key", key)
        each = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key_").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key_")))
        level = each.toDF("key", "path", "v", "pos", "key_", "value").select("key", F.concat("path", step).alias("path"), F.col("value").alias("v"))
