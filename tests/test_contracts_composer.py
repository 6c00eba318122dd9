"""Record contracts, texts at any depth, and composed examples, against plain versions."""

import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import composer as M
from quillstone.operators import contracts as C

GOOD = {"participant_id": "P07", "scenario_id": "S-01", "experiment_id": "e", "session": 6, "date": "2026-04-10", "system_state": "warning_only", "usefulness": 7.5, "risk_score": 0, "anchors_available": ["a", "b"], "anchors_used": ["b"], "edit_made": True, "rewrite_decision": "accept_with_edits"}


def test_record_errors(spark):
    cases = [
        (GOOD, []),
        (GOOD | {"participant_id": "P7"}, ["participant_id 'P7' does not match 'P\\d{2,}'"]),
        (GOOD | {"participant_id": "P07\n"}, ["participant_id 'P07\n' does not match 'P\\d{2,}'"]),
        (GOOD | {"participant_id": None, "usefulness": None}, []),
        ({k: v for k, v in GOOD.items() if k != "date"}, ["missing required field 'date'"]),
        (GOOD | {"usefulness": "7"}, ["usefulness must be numeric"]), (GOOD | {"usefulness": True}, ["usefulness must be numeric"]), (GOOD | {"usefulness": 10.5}, ["usefulness is outside [0, 10]"]),
        (GOOD | {"time_to_decision_seconds": -1}, ["time_to_decision_seconds is outside [0, ]"]), (GOOD | {"risk_score": 1e-9}, []),
        (GOOD | {"detected_risk": "true"}, ["detected_risk must be boolean"]),
        (GOOD | {"anchors_used": ["z", "b", "c"]}, ["anchors_used not in anchors_available: c, z"]), (GOOD | {"anchors_used": "b"}, ["anchors_used must be a list"]),
        (GOOD | {"edit_made": None}, ["accept_with_edits needs edit_made"]),
        (GOOD | {"system_state": "risk_negative_passthrough", "detected_risk": True}, ["risk_negative_passthrough cannot have detected_risk", "risk_negative_passthrough needs rewrite_decision not_applicable"]),
        (GOOD | {"system_state": "else"}, ["system_state 'else' is not one of " + ", ".join(sorted(C.STATES))]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(99, "no json"), (100, None)], "i int, j string")
    got = {r["i"]: r["e"] for r in rows.select("i", C.errors(F.try_parse_json("j"), C.RECORD_RULES).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)} | {99: ["not a JSON record"], 100: ["not a JSON record"]}


def test_config_errors(spark):
    good = {"experiment_id": "e", "session": 6, "experiment_type": "user_evaluation", "random_seed": 1, "metrics": [], "output": {}, "validation": {}, "user_study": {"core_scenarios": ["a"], "optional_scenarios": ["b"]}}
    assert C.config_errors(spark, good, C.CONFIG_RULES) == []
    assert C.config_errors(spark, good | {"session": 0, "user_study": {"core_scenarios": ["a"], "optional_scenarios": ["a"]}, "dataset": {"revision": "TBD"}}, C.CONFIG_RULES) == ["session is outside [1, ]", "scenario ids appear more than once", "dataset revision is still TBD"]
    assert C.config_errors(spark, [1], C.CONFIG_RULES)[:2] == ["missing required field 'experiment_id'", "missing required field 'experiment_type'"]


def plain_leaves(value, path=""):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from plain_leaves(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_leaves(v, f"{path}[{i}]")


def test_texts_at_any_depth(spark):
    values = [{"a": {"b": [{"c": {"d": ["x", None, {"e": "deep"}], "n": 5}}, []]}, "t": ""}, "just text", [["l", ["m"]]], {}, None, 7, {"a": [None, True]}]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").withColumn("v", F.parse_json("j"))
    got = sorted((r["i"], r["path"], r["text"]) for r in C.walked(rows, "i", "v").collect())
    assert got == sorted((i, p, t) for i, v in enumerate(values) for p, t in plain_leaves(v))
    assert C.walked(rows.limit(0), "i", "v").count() == 0


def test_typed_texts_at_any_depth(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("m", T.MapType(T.StringType(), T.ArrayType(T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.IntegerType())])))), T.StructField("k", T.ArrayType(T.IntegerType()))]))), T.StructField("s", T.StringType())])
    value = {"a": [{"m": {"x": [{"s": "one", "n": 1}, {"s": None, "n": 2}], "y": None}, "k": [1]}, None, {"m": {"z": [{"s": "mail a@b.cc", "n": 0}]}, "k": None}], "s": "two"}
    rows = spark.createDataFrame([(1, value), (2, None)], T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)]))
    got = sorted((r["i"], x["path"], x["text"]) for r in rows.select("i", C.leaves(F.col("v"), kind).alias("l")).collect() for x in r["l"])
    assert got == [(1, "a[0].m{x}[0].s", "one"), (1, "a[2].m{z}[0].s", "mail a@b.cc"), (1, "s", "two")]
    assert [tuple(r) for r in C.findings(rows, ["i"], "v").collect()] == [(1, "a[2].m{z}[0].s", "possible email address")]


# -- composed examples


def inputs(spark, texts, surfaces, n, parts=3):
    carriers = spark.createDataFrame([(i, t, h, p, None) for i, (t, h, p) in enumerate(texts)], "carrier long, text string, split_hint string, needs_persona boolean, persona_param string").repartition(parts)
    banks = spark.createDataFrame([(a, s, [s.upper()]) for a, s in surfaces], "attribute string, surface string, variants array<string>").repartition(parts)
    return spark.range(n).select(F.col("id").alias("example")).repartition(parts), carriers, banks


TEXTS = [("Which tea is best, the green or the black?", None, False), ("How long does bread keep", None, True), ("Tell me about Oslo, please; I like Oslo", " about ", True), ("Explain the oldest rules of chess for beginners in clubs", None, False), (" ", None, False), (None, None, True)]
BANK = [("location", "Oslo"), ("location", "Rome"), ("occupation", "baking"), ("education", "the night school"), ("age", "40-year-old"), ("local_reference", "the corner shop"), ("unknown", "never")]


def test_composed_examples(spark):
    made = M.composed(*inputs(spark, TEXTS, BANK, 400)).collect()
    again = M.composed(*inputs(spark, TEXTS, BANK, 400, parts=7)).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))  # whatever the partitioning
    assert len({r["input"] for r in made}) == len(made) > 50
    frames = {p: [re.compile(re.sub(r"\\\{.*?\\\}", ".+", re.escape(f))) for f in fs] for p, fs in M.FRAMES.items()}
    for r in made:
        text = TEXTS[r["carrier"]][0].strip()
        assert r["carrier"] < 4 and r["target"].endswith(text)
        surfaces = [f["surface"] for f in r["facts"]]
        assert all(s in r["input"] or s.capitalize() in r["input"] or s[0].upper() + s[1:] in r["input"] for s in surfaces)
        assert "never" not in surfaces and len(surfaces) == len({f["attribute"] for f in r["facts"]}) <= 3
        if r["carrier"] == 2:
            assert "Oslo" not in surfaces  # it stands in the text
        if r["position"] == "none":
            assert (r["input"], r["target"], surfaces, r["frame"], r["needs_persona"]) == (text, text, [], -1, False)
        else:
            assert surfaces and r["position"] in (M.POSITIONS[r["example"] % 5], "parenthetical")
            assert r["needs_persona"] == TEXTS[r["carrier"]][2] == r["target"].startswith("For someone ")
            assert any(p.fullmatch(r["input"]) or p.fullmatch(r["input"][0].lower() + r["input"][1:]) for p in frames[r["position"]]), r["input"]
    assert not any(r["position"] == "mid_sentence" and r["carrier"] == 1 for r in made)  # no place to part it
    assert {r["position"] for r in made} == {*M.POSITIONS, "none"}
    assert M.leaking(M.composed(*inputs(spark, TEXTS, BANK, 400))).count() == 0


def test_composed_without_a_fact_or_a_bank(spark):
    only = M.composed(*inputs(spark, [("Rome or Oslo? ROME!", None, True)], BANK[:2], 20), noop=0.0).collect()
    assert [(r["position"], r["input"], r["target"]) for r in only] == [("none", "Rome or Oslo? ROME!", "Rome or Oslo? ROME!")]  # equal inputs: the first stays
    assert M.composed(*inputs(spark, TEXTS, [("unknown", "x")], 5)).where("position <> 'none'").count() == 0
    assert M.composed(*inputs(spark, [(None, None, False)], BANK, 5)).count() == 0


def test_phrases_stand_between_words(spark):
    cases = [("in Rome.", "rome", True), ("Romeo", "Rome", False), ("a+b", "a+b", True), (r"x \E y", r"\E", True), ("été", "t", False), ("x", "", False), ("x", None, False), (None, "x", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p string, w boolean")
    assert all(r["got"] == r["w"] for r in rows.select("*", M.holds(F.col("t"), F.col("p")).alias("got")).collect())


def test_leaks_are_found(spark):
    rows = spark.createDataFrame([(1, "near Rome now", [("location", "Rome", ["ROMA"], "in Rome")]), (2, "roma", [("location", "Rome", ["ROMA"], "in Rome")]), (3, "Romes", [("location", "Rome", None, "in Rome")])], "example long, target string, facts array<struct<attribute:string,surface:string,variants:array<string>,fragment:string>>")
    assert sorted(r["example"] for r in M.leaking(rows).collect()) == [1, 2]


@pytest.mark.parametrize("text, head, tail", [("a, b; c", "a, b", "c"), ("what should one know about tea in Go", "what should one know about tea", "in Go"), ("short in Go", None, None), ("ends,", None, None)])
def test_places_to_part_a_text(text, head, tail):
    m = re.search(M.PARTS[0].replace(r"\z", r"\Z"), text) or re.search(M.PARTS[1].replace(r"\z", r"\Z"), text)
    assert (m and m[1], m and m[2]) == (head, tail)
