"""Known input and output pairs."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import leakage, metrics


def test_bands(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.29, 0.30, 0.59, 0.60, 1.0)], "p double")
    assert [r[0] for r in df.select(V.band(F.col("p"))).collect()] == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH"]
    for bad in (-0.01, 1.01):
        with pytest.raises(Exception, match="risk score"):
            spark.createDataFrame([(bad,)], "p double").select(V.band(F.col("p"))).collect()


def test_cumulative(spark):
    schema = "conv_id int, turn int, age double, location double, occupation double, education double"
    rows = leakage.cumulative_risk(spark.createDataFrame([(1, 1, 0.30, 0.0, 0.0, 0.0), (1, 2, 0.40, 0.0, 0.0, 0.0)], schema)).orderBy("turn").collect()
    assert [r["cum_age"] for r in rows] == [0.30, 0.58] and [r["delta"] for r in rows] == [0.30, 0.28]
    quiet = leakage.cumulative_risk(spark.createDataFrame([(1, i, 0.05, 0.05, 0.05, 0.05) for i in range(20)], schema)).collect()
    assert all(r["overall"] <= 0.05 and not r["breached"] and r["capacity"] >= 3.8 for r in quiet)


HITS = [
    ("OR", "Orlando", False), ("me", "Augusta, ME", False), ("Augusta, ME", "Augusta", True), ("Orleans", "New Orleanian", False), ("61", "61", True), ("unknown", "unknown", False),
    ("Pastry Cook", "Ship Cook", False), ("attorney", "Lawyer", True), ("mid 50s", "55", True), ("mid 50s", "59", False), ("72", "30s", False),
]


def test_attack_success(spark):
    df = spark.createDataFrame(HITS, "g string, t string, hit boolean")
    wrong = df.where(V.attack_success(F.col("g"), F.col("t")) != F.col("hit")).collect()
    assert wrong == []


def test_marker_attack(spark):
    df = spark.createDataFrame([("The co-op on our street sells good bread.",)], "t string")
    assert df.select(V.attack_guess(F.col("t"), "location")).first()[0] == "unknown"


def test_degeneracy(spark):
    long = "The committee postponed its review of the new bridge until the budget is known."
    rows = [(long, "", "empty"), (long, "Bridge.", "length"), ("Send the parcel before noon.", "7 8 9 10 11 12 noon", "non_alphabetic")]
    out = spark.createDataFrame(rows, "a string, b string, want string").select("want", T.degeneracy(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def test_runs(spark):
    rows = [("An engineer checked the pump.", "software engineer"), ("Room 310 is free.", "31")]
    df = spark.createDataFrame(rows, "t string, n string")
    assert [r[0] for r in df.select(T.contains_run(T.alnum_tokens(F.col("t")), T.alnum_tokens(F.col("n")))).collect()] == [False, False]


def test_brier(spark):
    df = spark.createDataFrame([("a", p, y) for p, y in ((0.2, 0), (0.4, 0), (0.6, 1), (0.8, 1))], "attribute string, p double, y int")
    assert metrics.calibration(df, bins=5).first()["brier"] == pytest.approx(0.1)
