"""Split manifests, the gate over reports, and success tables, by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.operators import contracts as C
from quillstone.operators import evaluation as E
from quillstone.sources import manifest


def test_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "ROWS_A_FILE", 4)
    path = str(tmp_path / "splits")
    rows = [(i, f"text {i}\nline", s) for i, s in enumerate(["train"] * 10 + ["a b"] * 3 + ["test"] * 2)]
    manifest.write(spark.createDataFrame(rows, "id int, text string, split string").repartition(2), path, seed=7)
    listed = manifest.listed(spark, path).collect()
    assert sum(r["rows"] for r in listed) == 15 and len(listed) >= 5 and {r["seed"] for r in listed} == {7}
    assert sorted(r["id"] for r in manifest.read(spark, path, "train", "id int, text string", seed=7).collect()) == list(range(10))
    for split, seed, error in (("test", None, PermissionError), ("none", None, ValueError), ("train", 8, ValueError)):
        with pytest.raises(error):
            manifest.read(spark, path, split, "id int", seed=seed)
    folder = f"{path}/data/split=train"
    one, two = sorted(f for f in os.listdir(folder) if f.startswith("part-"))[:2]
    with open(f"{folder}/{one}", "a") as f:
        f.write('{"id":99}\n')
    os.remove(f"{folder}/.{one}.crc")
    os.rename(f"{folder}/{two}", f"{folder}/part-else")
    os.rename(f"{folder}/.{two}.crc", f"{folder}/.part-else.crc")
    states = {(r["split"], r["file"]): r["state"] for r in manifest.compared(spark, path).collect()}
    assert (states["train", one], states["train", two], states["train", "part-else"]) == ("changed", "missing", "extra")
    gates = {r["split"]: (r["gate"], r["reasons"]) for r in manifest.gates(spark, path).collect()}
    assert gates == {"train": ("BLOCKED", "changed 1, missing 1, extra 1"), "a b": ("READY", ""), "test": ("READY", "")}
    with pytest.raises(ValueError, match="is "):
        manifest.read(spark, path, "train", "id int")
    assert manifest.read(spark, path, "a b", "id int").count() == 3


def test_gate(spark):
    hard, soft = (C.Required("a"), C.Equals("a", 1)), (C.Number("u", 0.5),)
    rows = [('{"a":1,"u":0.6}', "PASS", []), ('{"a":1,"u":0.1}', "DIAGNOSTIC_ONLY", ["u is outside [0.5, ]"]), ('{"u":0.1}', "BLOCKED", ["missing required field 'a'", "u is outside [0.5, ]"]), ("no", "BLOCKED", ["not a JSON record"]), (json.dumps({"a": 2}), "BLOCKED", ["a mismatch: 2 is not 1"])]
    df = spark.createDataFrame([(i, j) for i, (j, *_) in enumerate(rows)], "i int, j string")
    got = {r["i"]: (r["g"]["status"], r["g"]["reasons"]) for r in df.select("i", E.gate(F.try_parse_json("j"), hard, soft).alias("g")).collect()}
    assert got == {i: (s, e) for i, (_, s, e) in enumerate(rows)}


def test_success_tables(spark):
    rows = [("direct", "age", "raw", True), ("direct", "age", "raw", False), ("direct", "age", "new", False), ("direct", "age", "new", False), ("direct", "city", "old", True), ("complicated", "age", "raw", True)]
    df = spark.createDataFrame(rows, "hardness string, attribute string, variant string, hit boolean")
    assert sorted(map(str, E.by_hardness(df, ["raw", "new"]).collect())) == sorted(map(str, spark.createDataFrame([("direct", "raw", 2, 0.5, 0.0), ("direct", "new", 2, 0.0, 0.5), ("indirect", "raw", 0, None, None), ("indirect", "new", 0, None, None), ("complicated", "raw", 1, 1.0, 0.0), ("complicated", "new", 0, None, None)], "hardness string, variant string, n long, asr double, reduction double").collect()))
    d = {r["attribute"]: tuple(r)[1:] for r in E.deltas(df, "raw", "old", "new").collect()}
    assert d == {"age": (3, 0.6667, None, 0.0, None), "city": (0, None, 1.0, None, None), "all": (3, 0.6667, 1.0, 0.0, 1.0)}
    lines = [r["markdown"] for r in E.matrix(spark.createDataFrame([("b|c", None), ("a", 1)], "k string, n int"), ["k", "n"]).orderBy("line").collect()]
    assert lines == ["| k | n |", "|-|-|", "| a | 1 |", r"| b\|c | – |"]
