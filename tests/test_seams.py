"""Model seams: what they pass on, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import seams as S


def test_models_as_columns(spark):
    df = spark.createDataFrame([(1, "in Rome", "in Oslo, Rome"), (2, None, "Oslo"), (3, "x", None)], "i int, a string, b string")
    risk = S.risk_model(lambda: lambda texts: [{"age": min(1.0, len(t) / 10)} for t in texts])
    made = S.candidate_model(lambda: lambda texts: [[t, t.upper(), "", " ", t] for t in texts])
    new = S.value_scanner(lambda: lambda texts: [[c for c in ("Rome", "Oslo") if c in t] for t in texts])
    cues = S.attributor(lambda: lambda texts: [[("location", 0, 1, 0.5)] if t else [] for t in texts])
    rows = df.select("i", risk(F.col("a")).alias("r"), made(F.col("a")).alias("c"), new(F.col("a"), F.col("b")).alias("n"), cues(F.col("a")).alias("q")).orderBy("i").collect()
    assert [r["r"] for r in rows] == [{"age": 0.7}, {"age": 0.0}, {"age": 0.1}]
    assert [r["c"] for r in rows] == [["in Rome", "IN ROME"], [], ["x", "X"]]
    assert [r["n"] for r in rows] == [["Oslo"], ["Oslo"], []]
    assert [[tuple(c) for c in r["q"]] for r in rows] == [[("location", 0, 1, "i", 0.5)], [], [("location", 0, 1, "x", 0.5)]]


@pytest.mark.parametrize("seam, words", [
    (lambda: S.risk_model(lambda: lambda texts: [{"age": 1.5} for _ in texts]), "outside 0 to 1"),
    (lambda: S.risk_model(lambda: lambda texts: []), "results for"),
    (lambda: S.attributor(lambda: lambda texts: [[("age", 0, 99, 1.0)] for _ in texts]), "outside its text"),
])
def test_wrong_models_fail(spark, seam, words):
    with pytest.raises(Exception, match=words):
        spark.createDataFrame([("abc",)], "a string").select(seam()(F.col("a"))).collect()
