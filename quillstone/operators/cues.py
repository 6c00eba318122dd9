"""Cues: the parts of a text that give an attribute away, as column expressions over arrays.

Places are found by splitting at a pattern, pieces of a text become words by the places where they stop touching, and
choices in order are folds. Nothing here needs Python on the executors; only a model's scores, which come as columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions.text import let

CUE = "struct<attribute:string,start:int,end:int,surface:string,importance:double>"
_SPAN = "struct<start:int,end:int,score:double>"
#: Limits of words and phrases: share of the best word's salience, characters of a phrase, pieces of a candidate list.
PHRASE_LENGTH, PHRASE_FLOOR = 35, 0.20
CANDIDATES, KEPT, LEAST = 6, 3, 0.15
# Words that are no cues by themselves.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "you", "your", "he", "him", "his", "she", "her", "it", "its", "them", "their", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "can", "will", "just", "should", "now", "would", "could",
)
#: What is stripped from both ends of a span: ASCII punctuation and white space.
_EDGE = r"[\s!-/:-@\[-`{-~]+"


def none_of(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(lengths: Column) -> Column:
    """array<int>: sums of each entry and those before it. The fold writes them into a text, as what a fold holds is copied
    whole at every step, and an array is copied entry by entry."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, n: Column) -> Column:
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], (s["at"] + n).cast("string"), F.lit(" ")).alias("out"))

    sums = F.aggregate(lengths, zero, step, lambda s: s["out"])
    return F.slice(F.split(sums, " "), F.lit(1), F.size(lengths)).cast("array<int>")


def places(text: Column, pattern: str) -> Column:
    """array<struct<start,end,surface>>: where the pattern's matches stand. What lies between them is a split at the pattern,
    so places are sums of lengths."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # The last piece of the split follows the last match and has no partner.
    pairs = F.filter(F.zip_with(between, found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"))), lambda x: x["hit"].isNotNull())
    ends = running(F.transform(pairs, lambda x: x["gap"] + x["hit"]))
    return F.zip_with(found, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("surface")))


def pattern_cues(text: Column, scores: Column, floor: float = P.CUE_FLOOR) -> Column:
    """array of cues: matches of the patterns of each attribute whose score (map attribute -> score) reaches the floor, each
    surface once, whatever its case. Without any, one cue without a place for each such attribute. Null text: none found."""
    score = lambda a: F.coalesce(F.element_at(scores, F.lit(a)), F.lit(0.0))
    whole = F.coalesce(text, F.lit(""))

    def of(a: str, p: str) -> Column:
        there = F.transform(places(whole, f"(?iU){p}"), lambda m: F.struct(F.lit(a).alias("attribute"), m["start"].alias("start"), m["end"].alias("end"), F.trim(m["surface"]).alias("surface"), F.round(score(a), 2).alias("importance")))
        return F.when(score(a) >= floor, there).otherwise(none_of(CUE))

    every = F.filter(F.concat(*(of(a, p) for a, ps in P.PRESENCE_CUES.items() for p in ps)), lambda c: F.length(c["surface"]) >= 2)
    new = lambda kept, c: ~F.exists(kept, lambda k: F.lower(k["surface"]) == F.lower(c["surface"]))
    once = F.aggregate(every, none_of(CUE), lambda kept, c: F.when(new(kept, c), F.concat(kept, F.array(c))).otherwise(kept))
    nowhere = [F.when(score(a) >= floor, F.struct(F.lit(a).alias("attribute"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit(a).alias("surface"), F.round(score(a), 2).alias("importance"))) for a in P.PRESENCE_CUES]
    return let(once, lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array_compact(F.array(*nowhere))))


def _cut(items: Column, breaks: Callable[[Column, Column], Column]) -> Column:
    """array of arrays: items in order, cut before each one that breaks(the one before, it)."""

    def cut(p: Column) -> Column:
        heads = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | breaks(F.get(p, i - 1), x), i)), lambda i: i.isNotNull())
        return let(heads, lambda h: F.transform(h, lambda a, j: F.slice(p, a + 1, F.coalesce(F.get(h, j + 1), F.size(p)) - a)))

    return let(items, cut)


def _joined(run: Column) -> Column:
    """One span over a run of pieces, with the sum of their scores."""
    return F.struct(F.get(run, F.lit(0))["start"].alias("start"), F.element_at(run, -1)["end"].alias("end"), F.aggregate(run, F.lit(0.0), lambda s, x: s + x["score"]).alias("score"))


def words_of(pieces: Column) -> Column:
    """array<struct<start,end,score>>: sub-word pieces (start, end, score) that touch are one word. Empty pieces count for
    nothing."""
    return F.transform(_cut(F.filter(pieces, lambda x: x["start"] < x["end"]), lambda a, b: a["end"] != b["start"]), _joined)


def _within(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def phrases(text: Column, pieces: Column) -> Column:
    """array<struct<start,end,score>>, the best first: words whose salience is at least a fifth of the best word's and that are
    no stop words; neighbours with one blank between them are a phrase of up to PHRASE_LENGTH characters, as salient as its
    best word. Null text or pieces: none."""

    def chosen(words: Column) -> Column:
        return let(F.array_max(F.transform(words, lambda w: w["score"])), lambda top: worthy(words, top))

    def worthy(words: Column, top: Column) -> Column:
        bare = lambda w: F.lower(F.trim(F.regexp_replace(_within(text, w), r"(?U)[^\w\s-]", "")))
        good = lambda w: let(bare(w), lambda b: (F.length(b) >= 2) & ~F.array_contains(F.lit(list(STOP_WORDS)), b))
        share = F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (w["score"] / top).alias("score")))
        return F.when(top > 1e-9, F.filter(share, lambda w: (w["score"] >= PHRASE_FLOOR) & good(w))).otherwise(none_of(_SPAN))

    def follows(last: Column, w: Column) -> Column:
        return F.substring(text, last["end"] + 1, w["start"] - last["end"]) == " "

    def step(s: Column, w: Column) -> Column:
        last = F.element_at(s, -1)
        joins = w["end"] - last["start"] <= PHRASE_LENGTH
        both = F.struct(last["start"].alias("start"), w["end"].alias("end"), F.greatest(last["score"], w["score"]).alias("score"))
        return F.when((F.size(s) > 0) & joins, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(both))).otherwise(F.concat(s, F.array(w)))

    # Only words with one blank between them can be one phrase; such runs are short and are folded one by one.
    runs = _cut(let(words_of(pieces), chosen), lambda a, b: ~follows(a, b))
    merged = F.flatten(F.transform(runs, lambda run: F.aggregate(run, none_of(_SPAN), lambda s, w: F.when(F.size(s) == 0, F.array(w)).otherwise(step(s, w)))))
    ranked = F.array_sort(F.transform(merged, lambda w: F.struct((-w["score"]).alias("o"), w["start"].alias("start"), w["end"].alias("end"))))
    return F.coalesce(F.transform(ranked, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (-w["o"]).alias("score"))), none_of(_SPAN))


def token_cues(text: Column, tokens: Column, entities: Column, floor: float = PHRASE_FLOOR, most: int = 5) -> Column:
    """array<struct<surface,start,end,importance>>: attribution scores of tokens (start, end, score) as cues. Tokens within an
    entity (start, end) are that entity, the first of those that hold the first of them; others are words by touch. A span
    counts once, with its best place and score; scores are shares of the best; those of at least `floor` stand, best first,
    equals by surface, at most `most`. Negative sums count as 0; no positive score: none."""
    inside = lambda e, x: (e["start"] <= x["start"]) & (x["end"] <= e["end"])

    def grouped(t: Column, ents: Column) -> Column:
        """Where neither touch nor a shared entity holds two tokens together, a group surely ends; what lies between two such
        places is short and is folded."""
        sure = _cut(t, lambda a, b: (a["end"] != b["start"]) & ~F.exists(ents, lambda e: inside(e, a) & inside(e, b)))

        def step(s: Column, x: Column) -> Column:
            last = F.element_at(s, -1)
            held = F.when(last["entity"].isNotNull(), inside(last["entity"], x)).otherwise(last["end"] == x["start"])
            entity = F.get(F.filter(ents, lambda e: inside(e, x)), F.lit(0))
            entity = F.when(entity.isNotNull(), F.struct(entity["start"].alias("start"), entity["end"].alias("end")))
            grown = F.struct(last["start"].alias("start"), F.when(last["entity"].isNotNull(), last["end"]).otherwise(x["end"]).alias("end"), (last["score"] + x["score"]).alias("score"), last["entity"].alias("entity"))
            new = F.struct(F.coalesce(entity["start"], x["start"]).alias("start"), F.coalesce(entity["end"], x["end"]).alias("end"), x["score"].alias("score"), entity.alias("entity"))
            return F.when((F.size(s) > 0) & held, F.concat(F.slice(s, 1, F.size(s) - 1), F.array(grown))).otherwise(F.concat(s, F.array(new)))

        none = none_of("struct<start:int,end:int,score:double,entity:struct<start:int,end:int>>")
        return F.flatten(F.transform(sure, lambda run: F.aggregate(run, none, lambda s, x: F.when(F.size(s) == 0, step(none, x)).otherwise(step(s, x)))))

    def bare(g: Column) -> Column:
        def stripped(raw: Column, left: Column) -> Column:
            return let(F.regexp_replace(F.substring(raw, left + 1, F.length(raw)), f"{_EDGE}$", ""), lambda b: F.struct((-F.greatest(F.lit(0.0), g["score"])).alias("o"), b.alias("surface"), (g["start"] + left).alias("start"), (g["start"] + left + F.length(b)).alias("end")))

        return let(_within(text, g), lambda raw: let(F.length(F.regexp_extract(raw, f"^{_EDGE}", 0)), lambda left: stripped(raw, left)))

    whole = F.filter(F.coalesce(tokens, none_of(_SPAN)), lambda x: x["start"] < x["end"])
    ents = F.coalesce(entities, none_of("struct<start:int,end:int>"))
    spans = let(whole, lambda t: let(ents, lambda e: F.transform(grouped(t, e), bare)))
    spans = F.filter(spans, lambda s: s["surface"].rlike(r"[\p{L}\p{N}]"))
    kind = "struct<o:double,surface:string,start:int,end:int>"

    def picked(all_spans: Column) -> Column:
        return let(-F.array_min(F.transform(all_spans, lambda s: s["o"])), lambda top: ranked_cues(all_spans, top))

    def ranked_cues(all_spans: Column, top: Column) -> Column:
        share = F.transform(all_spans, lambda s: F.struct((-F.round(-s["o"] / top, 4)).alias("o"), s["surface"].alias("surface"), s["o"].alias("exact"), s["start"].alias("start"), s["end"].alias("end")))
        worthy = F.filter(share, lambda s: -s["o"] >= floor)
        # In order, an entry stands if it is the first of its surface; at most `most` of these are kept.
        first = lambda ranked: let(F.transform(ranked, lambda s: s["surface"]), lambda names: F.filter(ranked, lambda s, i: F.array_position(names, s["surface"]) == i + 1))
        plain = F.transform(F.slice(let(F.sort_array(worthy), first), 1, most), lambda s: F.struct(s["o"].alias("o"), s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(top > 1e-9, plain).otherwise(none_of(kind))

    best = let(spans, picked)
    return F.coalesce(F.transform(best, lambda s: F.struct(s["surface"].alias("surface"), s["start"].alias("start"), s["end"].alias("end"), (-s["o"]).alias("importance"))), none_of("struct<surface:string,start:int,end:int,importance:double>"))


def verified(rows: DataFrame, keys: list[str], text: str, candidates: str, scores: Callable[[Column], dict[str, Column]], mask: str = "[MASK]") -> DataFrame:
    """(keys, attribute, start, end, surface, drop, importance): cues that matter when they are taken away.

    candidates is an array<struct<attribute,start,end,share>>, of which the first CANDIDATES of an attribute are tried. Each
    text becomes one row for each of them, with the span masked, and one pass scores all these rows; a model may give the
    scores. importance = .55 share + .45 min(1, drop / max(score, .1)), at most 1, where drop is what masking takes from
    the attribute's score; null texts have no cues. Of each attribute the KEPT most important cues of at least LEAST stand, equals in the order
    given. The one shuffle is on the keys, of rows without texts."""
    nth = F.transform(candidates, lambda c, i: F.struct(i.alias("place"), c.alias("c")))
    tried = F.filter(nth, lambda x: F.size(F.filter(nth, lambda y: (y["place"] < x["place"]) & (y["c"]["attribute"] == x["c"]["attribute"]))) < CANDIDATES)
    of = lambda column, attribute: F.coalesce(*(F.when(F.col(attribute) == a, s) for a, s in scores(column).items()))
    base = F.create_map(*(x for a, s in scores(F.col(text)).items() for x in (F.lit(a), s)))
    each = rows.where(rows[text].isNotNull()).select(*keys, text, base.alias("base"), F.explode(tried).alias("x")).select(*keys, text, "base", "x.place", "x.c.*")
    surface = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    masked = F.concat(F.substring(F.col(text), F.lit(1), F.col("start")), F.lit(mask), F.substring(F.col(text), F.col("end") + 1, F.length(text)))
    each = each.select(*keys, "place", "attribute", "start", "end", "share", surface.alias("surface"), F.element_at("base", F.col("attribute")).alias("before"), masked.alias("masked"))
    each = each.withColumn("drop", F.greatest(F.lit(0.0), F.col("before") - of(F.col("masked"), "attribute")))
    importance = F.least(F.lit(1.0), 0.55 * F.col("share") + 0.45 * F.least(F.lit(1.0), F.col("drop") / F.greatest("before", F.lit(0.1))))
    each = each.select(*keys, "place", "attribute", "start", "end", "surface", F.round("drop", 4).alias("drop"), importance.alias("importance")).where(F.col("importance") >= LEAST)
    best = each.groupBy(*keys, "attribute").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("o"), "place", "start", "end", "surface", "drop"))), 1, KEPT).alias("best"))  # at most CANDIDATES a group
    out = best.select(*keys, "attribute", F.explode("best").alias("b")).select(*keys, "attribute", "b.*")
    return out.select(*keys, "attribute", "start", "end", "surface", "drop", F.round(-F.col("o"), 4).alias("importance"))
