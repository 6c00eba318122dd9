"""Results that are those of the SQL: ASCII words, exact shares, fillers that are whole words; composed rows by merge joins."""

from pyspark.sql import functions as F

from quillstone.functions import privacy as V
from quillstone.operators import answers as A
from quillstone.operators import composer as C
from quillstone.operators import spans, splits
from quillstone.functions import patterns as P


def test_neutral_ascii_words(spark):
    df = spark.createDataFrame([("Den mit\u00fc\u00fcver.",), ("\u00e4denver\u00df",), ("smith",)], "t string")
    assert [r[0] for r in df.select(V.neutral(F.col("t"), "education")).collect()] == ["Den higher education\u00fc\u00fcver.", "\u00e4denver\u00df", "smith"]
    assert [r[0] for r in df.select(V.neutral(F.col("t"), "location")).collect()][1] == "\u00e4the area\u00df"


def test_placeholders_ascii_words(spark):
    df = spark.createDataFrame([("mit\u00fc MIT, smith",)], "t string")
    assert df.select(V.placeholders(F.col("t"))).first()[0] == "[EDUCATION]\u00fc [EDUCATION], smith"


def test_attack_guess_accents(spark):
    df = spark.createDataFrame([("Den \u00e4, co und",), ("Den a, co\u00e4",)], "t string")
    assert [r[0] for r in df.select(V.attack_guess(F.col("t"), "location")).collect()] == ["Denver", "unknown"]


def test_guard_spans_ascii_words(spark):
    df = spark.createDataFrame([("google\u00fc googles",)], "t string")
    found = lambda **more: df.select(F.size(spans.explicit_spans(F.col("t"), P.SESSION_ENTITIES, ignore_case=True, **more))).first()[0]
    assert (found(), found(ascii_words=True)) == (0, 1)


def test_filler_is_a_word(spark):
    rows = ["Surenment le", "Okayama is far", "Sure thing", "Sure!so", "Okay, so", "Sure\u00e9 le"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(A.cleaned(F.col("t"))).collect()] == ["Surenment le", "Okayama is far", "thing", "so", "so", "Sure\u00e9 le"]


def test_shares_are_exact(spark):
    rows = splits.stratified(spark.range(45).select("id", F.lit("a").alias("s")), "id", "s")
    assert {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} == {"train": 32, "val": 7, "test": 6}


def test_composed_by_merge_joins(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C, "written", lambda df: seen.append(df) or df)
    carriers = spark.createDataFrame([(1, "Tell me, please", None, False, None)], "carrier long, text string, split_hint string, needs_persona boolean, persona_param string")
    banks = spark.createDataFrame([("location", "Rome", ["rome"])], "attribute string, surface string, variants array<string>")
    made = C.composed(spark.range(20).withColumnRenamed("id", "example"), carriers, banks)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=merge") >= 3 and made.count() > 0
