"""Bounds of the samples that models learn from, and texts of long runs."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import bpe, langid, packing, quality
from quillstone.llm.common import below_share, ship

JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("run", [" ", "\n", " ", " \n", "a", "ab", "1", "!", "é"])
def test_token_ids_of_long_runs(run):
    """Two million characters of one kind, between words."""
    text = "start" + run * (2_000_000 // len(run)) + "end"
    ids = packing.token_ids(JSON)(text)
    own = bpe.encoder(JSON)
    assert own.decode(pytest.importorskip("numpy").array(ids)) == text


@pytest.mark.parametrize("n", [4000, 4095, 4096, 5000])
def test_both_encoders_agree_around_the_limit(n):
    text = "one two" + " " * n + "three" + "\n" * n + "x" * 300
    library = packing._library_encoder(JSON)
    assert packing.token_ids(JSON)(text) == library.encode(text, allowed_special="all", disallowed_special=())


def test_packing_of_long_runs(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "a"), (3, None)], "doc_id long, text string")
    rows = packing.pack(docs, JSON, size=2048, end_id=1).collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3}


def test_a_share_never_comes_to_nothing(spark):
    """Of 100,000 hashes, shares as of ten billion rows: about as many as asked for, and an edge that is no class."""
    h = spark.range(100_000).select(F.xxhash64("id").alias("h"))
    for share in (1.0, 0.5, 1e-2, 1e-3):
        assert h.where(below_share(F.col("h"), share)).count() == pytest.approx(100_000 * share, rel=0.25)
    low = h.orderBy("h").first()["h"]
    total = 1e10
    assert spark.range(1).where(below_share(F.lit(-(1 << 63) + int((1 << 64) * 0.9 * 1000 / total)), 1000 / total)).count() == 1
    assert spark.range(1).where(below_share(F.lit(-(1 << 63) + int((1 << 64) * 1.1 * 1000 / total)), 1000 / total)).count() == 0
    assert h.where(below_share(F.col("h"), 1000 / total)).count() <= 1 and low < 0


def test_copies_do_not_thin_a_language(spark):
    ship(spark)
    rows = [(1, "immer die gleiche Zeile", "de")] * 3000 + [(i, f"word{i} of english", "en") for i in range(200)]
    languages, probs = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, max_rows=20)
    assert languages == ["de", "en"]


def test_classifier_rows_are_bounded_where_ids_repeat(spark, monkeypatch):
    ship(spark)
    seen = []
    monkeypatch.setattr(quality, "fit_rows", lambda rows, y: seen.append((len(rows), sum(r.nbytes for r in rows))) or "model")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    many = spark.createDataFrame([(1, f"text number {i}") for i in range(4000)] + [(2, "the same")] * 500, "doc_id long, text string")
    quality.fit(many, labels, max_rows=300)
    quality.fit(many, labels, max_bytes=4000)
    assert quality.fit(many.where("doc_id = 2"), labels) == "model"
    assert 150 < seen[0][0] < 500 and 0 < seen[1][1] < 12_000 and seen[2][0] == 1
