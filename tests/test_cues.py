"""Cue operators against plain versions: places, phrases, attributions of tokens with entities, masking."""

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quillstone.operators import cues as C
from quillstone.plans.inputs import messages, sentences

PIECE = "array<struct<start:int,end:int,score:double>>"
SPAN = "array<struct<start:int,end:int>>"


def test_places(spark):
    texts = ["a1b22c", "", "11", "x", "1", "1 2  3", "é9é", None, "end9", "👍7"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.places(F.col("t"), r"\d+").alias("p")).collect()
    for r in rows:
        want = None if r["t"] is None else [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+", r["t"])]
        assert (None if r["p"] is None else [tuple(x) for x in r["p"]]) == want


def test_phrases(spark):
    text = "I work as a soft ware engineer near Boston harbour."
    offsets = [(0, 1), (2, 6), (7, 9), (10, 11), (12, 16), (17, 19), (19, 21), (22, 30), (31, 35), (36, 39), (39, 42), (43, 50), (50, 51)]
    salience = [0.9, 0.1, 0.0, 0.0, 0.5, 0.3, 0.3, 0.8, 0.1, 0.5, 0.5, 0.3, 0.0]
    pieces = [(a, b, s) for (a, b), s in zip(offsets, salience, strict=True)]
    rows = [(text, pieces), ("", []), ("ab", [(0, 2, 0.0)]), ("ab", [(0, 0, 5.0), (0, 2, 1.0)]), (None, None), ("the", [(0, 3, 1.0)])]
    out = [[(r["t"][x["start"] : x["end"]], round(x["score"], 2)) for x in r["c"]] for r in spark.createDataFrame(rows, f"t string, p {PIECE}").select("t", C.phrases(F.col("t"), F.col("p")).alias("c")).collect()]
    assert out == [[("Boston harbour.", 1.0), ("soft ware engineer", 0.8)], [], [], [("ab", 1.0)], [], []]


def plain_cues(text, tokens, entities):
    """Groups as the tokens come, with a cursor; then the best of each surface."""
    tokens = [t for t in tokens if t[0] < t[1]]
    edge, spans, i = string.punctuation + string.whitespace, {}, 0
    while i < len(tokens):
        home = next((e for e in entities if e[0] <= tokens[i][0] and tokens[i][1] <= e[1]), None)
        j = i + 1
        while j < len(tokens) and (home[0] <= tokens[j][0] and tokens[j][1] <= home[1] if home else tokens[j][0] == tokens[j - 1][1]):
            j += 1
        a, b = home or (tokens[i][0], tokens[j - 1][1])
        surface = text[a:b].strip(edge)
        if any(c.isalnum() for c in surface):
            score = max(0.0, sum(t[2] for t in tokens[i:j]))
            at = a + len(text[a:b]) - len(text[a:b].lstrip(edge))
            if surface not in spans or score > spans[surface][0]:
                spans[surface] = (score, at)
        i = j
    top = max((s for s, _ in spans.values()), default=0.0)
    if top <= 1e-9:
        return []
    ranked = sorted((-round(s / top, 4), x, a) for x, (s, a) in spans.items() if round(s / top, 4) >= 0.20)
    return [(x, a, a + len(x), -s) for s, x, a in ranked[:5]]


def test_token_cues(spark):
    rng = random.Random(9)
    rows = [("", [], []), (None, None, None), ("ab", [(0, 2, -1.0)], None), ("New York, ok", [(0, 3, 0.5), (4, 8, 0.25), (8, 9, 0.125), (10, 12, 0.5)], [(0, 8)]), ("aXb", [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], [(1, 2), (0, 2)])]
    for _ in range(300):
        text = "".join(rng.choices("ab. -é", k=rng.randint(1, 30)))
        cuts = sorted(rng.sample(range(len(text) + 1), rng.randint(1, min(9, len(text) + 1))))
        tokens = [(a, b if rng.random() < 0.8 else max(a, b - 1), rng.choice([-0.25, 0.0, 0.25, 0.5, 1.0])) for a, b in zip(cuts, cuts[1:], strict=False)]
        entities = [tuple(sorted(rng.sample(range(len(text) + 1), 2))) for _ in range(rng.choice([0, 1, 3]))]
        entities += [(a, (a + b + 1) // 2) for a, b in entities[:1]]  # nested
        rows.append((text, tokens, entities))
    out = spark.createDataFrame(rows, f"t string, k {PIECE}, e {SPAN}").select("t", "k", "e", C.token_cues(F.col("t"), F.col("k"), F.col("e")).alias("c")).collect()
    for r in out:
        got = [tuple(x) for x in r["c"]]
        want = plain_cues(r["t"] or "", [tuple(x) for x in r["k"] or []], [tuple(x) for x in r["e"] or []])
        assert [(a, b, c, pytest.approx(d)) for a, b, c, d in want] == got, r


def test_pattern_cues(spark):
    scores = F.create_map(F.lit("age"), F.lit(0.72), F.lit("location"), F.lit(0.1))
    rows = spark.createDataFrame([(1, "I am 34 years old, 34 YEARS OLD"), (2, "nothing"), (3, None)], "i int, t string")
    got = {r["i"]: [tuple(c) for c in r["c"]] for r in rows.select("i", C.pattern_cues(F.col("t"), scores).alias("c")).collect()}
    assert all(a == "age" for a, *_ in got[1]) and len({s.lower() for *_, s, _ in got[1]}) == len(got[1]) > 0
    assert all("I am 34 years old, 34 YEARS OLD"[a:b].strip() == s for _, a, b, s, _ in got[1])
    assert got[2] == got[3] == [("age", None, None, "age", 0.72)]


def test_masking(spark):
    """Importance by hand: masking the only digit takes the score from .9 to .1."""
    scores = lambda t: {"age": F.when(t.rlike("[0-9]"), 0.9).otherwise(0.1), "location": F.lit(0.05)}
    c = [("age", 3, 4, 0.5), ("age", 0, 2, 1.0), ("location", 0, 2, 0.2), ("age", 0, 1, 0.3), ("age", 1, 2, 0.3), ("location", 0, 1, 1.0)]
    df = spark.createDataFrame([(1, "at 9", c), (2, None, c[:1]), (3, "x", [])], "id int, t string, c array<struct<attribute:string,start:int,end:int,share:double>>")
    got = sorted(map(tuple, C.verified(df, ["id"], "t", "c", scores).collect()))
    assert got == [
        (1, "age", 0, 1, "a", 0.0, 0.165), (1, "age", 0, 2, "at", 0.0, 0.55), (1, "age", 3, 4, "9", 0.8, pytest.approx(0.55 * 0.5 + 0.45 * 0.8 / 0.9, abs=1e-4)),
        (1, "location", 0, 1, "a", 0.0, 0.55),
    ]


def test_running_sums(spark):
    """Sums of a long array, by a fold that holds no array."""
    lengths = [i % 7 for i in range(3000)]
    rows = spark.createDataFrame([(1, lengths), (2, []), (3, None)], "i int, n array<int>").select("i", C.running(F.col("n")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {1: [sum(lengths[: i + 1]) for i in range(3000)], 2: [], 3: None}


def test_messages_are_dealt_by_rows(spark, tmp_path):
    """All splits of a file but one are empty if it has one row group; tasks get even shares even so."""
    spark.range(9000).selectExpr("id AS conv_id", "0 AS turn", "'user' AS role", "repeat(uuid(), 20) AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        for rows in (messages(spark, str(tmp_path)), sentences(spark, str(tmp_path))):
            n = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(n) == 9000 and max(n) < 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
