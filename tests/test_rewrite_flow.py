"""The rewrite flow at size: patterns that cannot match are passed by, counts replace folds; results stay as they were."""

import random
import re

from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T
from quillstone.operators import rewriting
from quillstone.plans import flow_queries
from quillstone.plans.inputs import SENTENCES

WORDS = (
    "I am 34 years old|living in|Denver|DENVER, CO|in Koſton|Boſton|anı MİT|mıt|worK as a|work  as a|nurse|cardiologist|in my 20s|a|an|A an|y/o|41 yo|été|ÉTÉ|İn my 30s|my boſſ"
    "|attending Some College|Master's degree|ph.d|grading papers|not|never|a@b.co|+1 555-123-4567|10.0.0.1|https://x.org/y|www.a.b|Jan 5, 2021|My name is Ann Lee|x1|7| |\n|my boss|retired|software engineer|intern at tech|(freshman)"
    "|As a teacher,|can you help?|By the way, I'm a poet.|these stats|Go on."
).split("|")


def texts(n=500):
    pick = random.Random(5)
    return ["", " ", *SENTENCES, *(pick.choice(["", " "]).join([" ".join(pick.choices(WORDS, k=pick.randint(1, 9))), pick.choice(WORDS)]) for _ in range(n))]


def frame(spark, values):
    return spark.createDataFrame([(i, t) for i, t in enumerate(values)] + [(-1, None)], "i long, text string").repartition(4)


def test_rules_that_cannot_match_are_passed_by_without_a_change(spark):
    t = F.col("text")
    chains = {n: getattr(P, n) for n in ("GENERAL", "MORE_GENERAL", "PLACEHOLDERS", "AGE_AND_ROLE", "ROLE_AND_SCHOOL", "FORMAL", "CASUAL", "NATURAL")}
    neutral = [x for a in P.ATTRIBUTES for x in P.NEUTRAL[a]]
    rows = frame(spark, texts())
    for rules, plain in [*((r, False) for r in chains.values()), (neutral, True)]:
        each = t
        for pattern, by in rules:
            each = F.regexp_replace(each, T.plain(T.led(pattern), True), by) if plain else T.replaced(each, pattern, by, ignore_case=True)
        whole = T.plain_chain(t, rules) if plain else T.chain(t, rules)
        assert not rows.where(~whole.eqNullSafe(each)).take(3)
    assert not rows.where(~V.identified(t).eqNullSafe(V.scrubbed(t)[1])).take(3)
    low = F.lower(t)
    for a, score in V.rule_scores(t).items():
        n = sum((F.regexp_count(low, F.lit(T.u(c))) for c in P.RULE_CUES[a]), F.lit(0))
        assert not rows.where(~score.eqNullSafe(F.element_at(F.array(*map(F.lit, P.RULE_STEPS)), F.least(n, F.lit(3)) + 1))).take(3)
    assert not rows.where(~V.overall_score(t).eqNullSafe(F.greatest(*V.rule_scores(t).values()))).take(3)


def test_needles_are_in_every_match():
    assert T.needles(rf"\b(?:{P.AGE_PHRASE})\b")[-3:] == ("y/o", "year", "yo") and T.needles(r"\d+[a-z]*") == () and T.needles(r"x?(?:ab|c)*") == ()
    assert T.needles(r"\b(?:in|to)\s+(?:Paris|New York)\b") == ("new york", "paris") and T.needles(r"mas(?:ter)?s") == ("mas",)


def test_pruning_looks_only_where_a_clause_may_be(monkeypatch):
    now = [rewriting.prune_text(t) for t in texts()]
    monkeypatch.setattr(rewriting, "_may", lambda rule, low: True)
    monkeypatch.setattr(rewriting, "_AS", lambda low: True)
    assert now == [rewriting.prune_text(t) for t in texts()]


def test_utility_from_counts_is_the_utility(spark):
    values = texts(300)
    rows = spark.createDataFrame(list(zip(values, values[7:] + values[:7], strict=True)) + [(t, t) for t in values], "a string, b string").repartition(4)
    rows = rewriting.with_counts(rows, "pair", F.col("a"), F.array("b"))
    counts = F.get("pair", F.lit(1))
    assert not rows.where(~rewriting.utility_of(F.col("pair")).eqNullSafe(T.utility(F.col("a"), F.col("b"))["utility"])).take(3)
    assert not rows.where(~counts["cosine"].eqNullSafe(T.token_cosine(F.col("a"), F.col("b")))).take(3)
    assert not rows.where(~T.degeneracy_by(F.get("pair", F.lit(0)), counts).eqNullSafe(T.degeneracy(F.col("a"), F.col("b")))).take(3)


def test_flow_has_no_fold_over_tokens(spark):
    for name in ("udf11_selected_rewrite", "plan_analyze"):
        plan = flow_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"\baggregate\(", plan) and "MapInArrow" in plan and len(plan) < 150_000


def test_messages_that_pass_are_not_rewritten(spark, monkeypatch):
    asked = []
    real = rewriting.with_candidates
    monkeypatch.setattr(rewriting, "with_candidates", lambda rows, text="text": asked.append((rows, text)) or real(rows, text))
    out = flow_queries.QUERIES["plan_analyze"](spark, "/root/testdata/sf0.001")
    rows, text = asked[0]
    assert 0 < rows.where(F.col(text).isNull()).count() == out.where("engine = 'passthrough' and served is not null").count()
