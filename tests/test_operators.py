import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import rewriting, spans
from quillstone.sources import files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_redaction_and_hardness(spark):
    assert one(spark, "My name is Ann Lee, a@b.org", V.redacted(F.col("t"))) == "My name is <PERSON>, <EMAIL>"
    assert one(spark, "  ", V.redacted(F.col("t"))) == ""
    assert one(spark, None, V.redacted(F.col("t"))) == ""
    assert one(spark, "nothing", V.hardness(F.col("t"))) == "direct"
    assert one(spark, "my advisor", V.hardness(F.col("t"))) == "indirect"


@pytest.mark.parametrize(
    "guess,truth,hit",
    [("Denver", "Denver, CO", True), ("CA", "Chicago", False), ("30s", "mid thirties 35", True), ("programmer", "Software Engineer", True), ("unknown", "x", False), ("25", "26", False), ("", "a", False), (None, "a", False)],
)
def test_attack_success(spark, guess, truth, hit):
    df = spark.createDataFrame([(guess, truth)], "g string, t string")
    assert df.select(V.attack_success(F.col("g"), F.col("t"))).first()[0] is hit


def test_attack_success_at_size(spark):
    """An age on one side only is no hit, and the plan stays small enough to be compiled."""
    df = spark.createDataFrame([("25-34", "unknown place", False), ("poet", "41", False), ("25-34", "28", True), ("swe", "a software developer", True)], "g string, t string, hit boolean")
    found = V.attack_success(F.col("g"), F.col("t"))
    assert df.where(found != F.col("hit")).collect() == []
    assert len(str(found)) < 30_000


def test_degeneracy(spark):
    d = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(T.degeneracy(F.col("a"), F.col("b"))).first()[0]
    assert d("one two three four", "") == "empty"
    assert d("one two three four", "go go go go go") == "repetition"
    assert d("one two three four five six seven eight", "one") == "length"
    assert d("one two three four", "one two three four") is None


def test_pruning():
    assert rewriting.prune_text("I'm a nurse. How do I file taxes?") == "How do I file taxes?"
    assert rewriting.prune_text("As a 34 yo, can you help me?") == "Can you help me?"
    assert rewriting.prune_text("How do I cook rice? (freshman at MIT)") == "How do I cook rice?"
    assert rewriting.prune_text(None) == ""


def test_spans_and_splice(spark):
    df = spark.createDataFrame([("mail a@b.org or a@b.org",), (None,)], "t string")
    found = df.select(spans.explicit_spans(F.col("t")).alias("s")).collect()
    assert [(s["start"], s["end"]) for s in found[0]["s"]] == [(5, 12), (16, 23)]
    assert found[1]["s"] == []
    named = spans.pseudonymised(spark.createDataFrame([(1, 1, "Google and Apple"), (1, 2, "apple again"), (2, 1, "none")], "conv_id int, turn int, text string"))
    assert {(r["conv_id"], r["turn"]): r["pseudonymised"] for r in named.collect()} == {(1, 1): "ORG_1 and ORG_2", (1, 2): "ORG_2 again", (2, 1): "none"}


def test_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(json.dumps({"id": "1", "author": "x", "text": "hello"}) + "\n\nnot json\n")
    rows = files.read_jsonl(spark, str(path)).cache()
    assert rows.where("_corrupt is null").count() == 1 and rows.where("_corrupt is not null").count() == 1
    with pytest.raises(ValueError):
        files.verified(spark, str(path), "0" * 64)
    with pytest.raises(PermissionError):
        files.verified(spark, str(tmp_path / "test.jsonl"), "0" * 64)
    assert files.flattened({"a": {"b": 1, "c": [1, 2]}}) == [("a.b", "1"), ("a.c", "[1, 2]")]


def test_bank(spark, tmp_path):
    from quillstone.operators import banks
    from quillstone.sources.banks import read_bank

    (tmp_path / "cities.json").write_text(json.dumps({"attribute": "location", "generalizations": ["my area"], "entries": [{"value": "New York", "variants": ["NYC"]}, {"value": "York"}]}))
    (tmp_path / "jobs.json").write_text(json.dumps({"attribute": "occupation", "generalizations": [], "entries": [{"value": "nurse", "generalizations": ["a health worker"]}]}))
    (tmp_path / "age.json").write_text(json.dumps({"attribute": "age", "entries": [{"pattern": r"\b\d{2}-year-old\b"}]}))
    bank = read_bank(*(str(tmp_path / f"{n}.json") for n in ("cities", "jobs", "age")))
    texts = ["I am a nurse in New York , a 34-year-old.", "New York State Penal Law", "a 34-year-old patient in Newyork", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").withColumn("m", banks.matches(F.col("t"), bank))
    rows = {r["id"]: r for r in df.select("id", "m", banks.neutral(F.col("t"), F.col("m")).alias("n")).collect()}
    assert [(m["attribute"], m["surface"]) for m in rows[0]["m"]] == [("occupation", "nurse"), ("location", "New York"), ("age", "34-year-old")]
    assert rows[0]["n"] == "I am a health worker in my area, a."
    assert rows[1]["n"] == texts[1] and rows[2]["n"] == texts[2]
    assert rows[3]["m"] == [] and rows[3]["n"] is None


def test_leakage_of_labels_equals_that_of_distributions(spark):
    from quillstone.operators import leakage as L

    rows = [(1, 1, "25-34", "us_west", "UNKNOWN", "phd"), (1, 2, "25-34", "canada", "other", "phd"), (1, 3, None, "us_west", "other", "college"), (2, 1, "UNKNOWN", None, "student", "UNKNOWN")]
    labels = spark.createDataFrame(rows, "conv_id int, turn int, age string, location string, occupation string, education string").fillna("UNKNOWN")
    want = {(r["conv_id"], r["turn"]): r for r in L.posterior_leakage(L.turn_distributions(labels)).collect()}
    for r in L.label_leakage(labels).collect():
        for c in ("age", "location", "occupation", "education", "leakage", "delta"):
            assert r[c] == pytest.approx(want[r["conv_id"], r["turn"]][c], abs=1e-3)


def test_one_confusion_table(spark):
    """Accuracy, abstention and macro F1 against a plain loop, with guesses outside the list and labels that never occur."""
    from quillstone.functions import patterns as P
    from quillstone.operators import metrics

    rows = [("m", "education", t, g) for t, g in [("phd", "phd"), ("phd", "master"), ("college", "UNKNOWN"), ("master", "master"), ("nothing", "phd"), ("college", "odd")]]
    out = metrics.attack_metrics(spark.createDataFrame(rows, "method string, attribute string, label string, guess string")).collect()
    kept = [(t, g) for *_, t, g in rows if t in P.TAXONOMY["education"]]
    f1 = [2 * sum(t == g == x for t, g in kept) / n if (n := sum((t == x) + (g == x) for t, g in kept)) else 0.0 for x in P.TAXONOMY["education"]]
    assert [(r["n"], r["accuracy"], r["abstained"], pytest.approx(r["macro_f1"])) for r in out] == [(5, 0.4, 0.2, sum(f1) / 4)]


def test_highlight(spark):
    from quillstone.operators import reporting as R
    from quillstone.operators.cues import CUE

    cues = [("location", 3, 9, "Boston", 0.72), ("age", 5, 12, "ston & ", 0.5), ("education", 12, 99, "M>T", 0.9), ("age", 4, 4, "", 1.0)]
    df = spark.createDataFrame([("in Boston & M>T", cues), ("a<b", None), (None, cues)], f"t string, c {CUE.join(['array<', '>'])}")
    mark = lambda a, s, x: f'<mark class="cue cue-{a}" data-attribute="{a}" data-importance="{s}">{x}<span class="cue-badge">{a}</span></mark>'
    out = [r[0] for r in df.select(R.highlighted(F.col("t"), F.col("c"))).collect()]
    assert out == [f"in {mark('location', '0.72', 'Boston')} &amp; {mark('education', '0.90', 'M&gt;T')}", "a&lt;b", ""]


def test_temperatures(spark):
    """The fitted temperature against a fine search in plain numpy; labels below zero are left out."""
    import numpy as np

    from quillstone.operators import reporting as R

    rng = np.random.default_rng(2)
    z = rng.normal(0, 3, (400, 3))
    y = np.array([rng.choice(3, p=np.exp(v / 2.5) / np.exp(v / 2.5).sum()) for v in z])
    rows = [("age", v.tolist(), int(k)) for v, k in zip(z, y, strict=True)] + [("age", [9.0, 0.0, 0.0], -100), ("age", None, 1)]
    got = R.fitted_temperatures(spark.createDataFrame(rows, "attribute string, logits array<double>, label int")).first()
    loss = lambda t: np.mean(np.log(np.exp(z / t).sum(axis=1)) - z[np.arange(400), y] / t)
    best = min(np.geomspace(0.05, 10, 20000), key=loss)
    assert got["n"] == 400 and got["temperature"] == pytest.approx(best, rel=0.02) and got["nll_after"] == pytest.approx(loss(best), abs=1e-3)
    assert got["nll_before"] == pytest.approx(loss(1.0), abs=1e-3)


def test_edit_ratio_and_diverse_candidates(spark):
    import difflib

    from quillstone.operators import reporting as R

    pairs = [("one two three four", "one three two four five"), ("", ""), (None, "x"), ("same words here", "same words here")]
    words = lambda t: (t or "").lower().split()
    out = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(R.edit_ratio(F.col("a"), F.col("b"))).collect()]
    assert out == pytest.approx([1 - difflib.SequenceMatcher(None, words(a), words(b)).ratio() for a, b in pairs])
    df = spark.createDataFrame([("I work as a nurse in Boston. How do I file taxes?",), (None,)], "text string")
    found = [r["candidates"] for r in rewriting.with_diverse_candidates(df).collect()]
    assert found[0][0] == "How do I file taxes?" and "around where I live" in found[0][2] and len(set(found[0])) == len(found[0])
    best = rewriting.with_best(rewriting.with_candidates(df.na.fill(""))).collect()
    assert [r["engine"] for r in best] == ["redaction", "redaction"] or best[0]["engine"] == "heuristic"


def test_led_patterns(spark):
    """A look at the first character comes before the edge of a word, and finds what the pattern finds."""
    assert T.led(r"\b(?:a\s+|an\s+)?(?:nurse|\d{2})\b").startswith(r"(?=[\dan])")
    assert T.led(r"https?://\S+|www\.\S+") == r"(?=[hw])(?:https?://\S+|www\.\S+)"
    assert [T.led(p) for p in ("a?", r"\w+", "[^a]", "(?i)a", r"\p{L}")] == ["a?", r"\w+", "[^a]", "(?i)a", r"\p{L}"]
    text = "A Nurse, ſcrubſ; nurses 42 www.x.orgé42 an  nurse"
    for p in (r"\b(?:a\s+|an\s+)?(?:nurse|\d{2})\b", r"\bscrubs\b", r"https?://\S+|www\.\S+"):
        plain, led = (F.regexp_extract_all(F.col("t"), F.lit(f"(?iU){x}"), F.lit(0)) for x in (p, T.led(p)))
        row = spark.createDataFrame([(text,)], "t string").select(plain.alias("a"), led.alias("b")).first()
        assert row["a"] == row["b"] != []
