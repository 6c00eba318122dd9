"""Composed training examples: facts about a person put into texts that need none, with the target that leaves them out.

Every choice is a draw: a hash of seed, example and slot, scaled to the number of things to choose from. So an example is
the same on any partitioning and in any run, and choices are joins on numbers: carriers and bank entries are numbered, and
an example meets the ones it drew. Planned sizes say little here: the examples are one narrow column of their table and
each has up to FACTS x tries draws, so every such join is told to be a merge join and none is sent through the driver. A fact is drawn up to `tries` times for a slot until neither its surface nor a variant
of it stands in the carrier as a phrase; all tries of an example come as one bounded list, so a text travels once.

An example takes one of five positions in turn. A carrier without a place to be parted, and a split with fewer than two
facts, are told in parentheses; without a fact left, and for a share of the examples, carrier and target are the same. Of
examples with the same input the first stays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import let
from quillstone.operators.running import numbered
from quillstone.sources.tables import written

POSITIONS = ("preamble", "postamble", "mid_sentence", "parenthetical", "split")
#: What stands around carrier and facts; {x^} begins with a capital, {x_} with a small letter.
FRAMES = {
    "preamble": ("Hello, I'm {facts}. {carrier}", "A word on me first: {facts}. {carrier}", "{facts^} writing here. {carrier}"),
    "postamble": ("{carrier} In case it matters, I'm {facts}.", "{carrier} I ask as {facts}.", "{carrier} About me: {facts}."),
    "mid_sentence": ("{head}, speaking as {facts_}, {tail}", "{head} - I'm {facts_} - {tail}", "{head}; as {facts_}; {tail}"),
    "parenthetical": ("{carrier} (I'm {facts}, by the way)", "{carrier} [{facts^}]", "(From {facts_}) {carrier}"),
    "split": ("I'm {first}. {carrier} And {others}, too.", "{first^} here. {carrier} I'm {others} as well.", "{carrier} I'm {first}; also {others}."),
}
#: How a fact of each attribute is told; {v} is its surface.
FRAGMENTS = {
    "age": ("a {v}", "someone who is a {v}"),
    "location": ("living in {v}", "at home in {v}", "from {v}"),
    "occupation": ("working in {v}", "employed in {v}"),
    "education": ("a student at {v}", "taught at {v}"),
    "local_reference": ("a customer of {v}", "a neighbour of {v}"),
}
#: What a target says instead, where the answer depends on the person.
PARAMETERS = {
    "age": ("of my age group", "at this time of life"),
    "location": ("in my part of the world", "in a place like mine"),
    "occupation": ("in my trade", "with a job like mine"),
    "education": ("with my schooling", "with a background like mine"),
    "local_reference": ("who relies on what is near", "with my local options"),
}
WEIGHTS = {"age": 0.25, "location": 0.25, "occupation": 0.2, "education": 0.2, "local_reference": 0.1}
#: Shares of examples with one and with at most two facts, and without any.
ONE, TWO, NOOP = 0.55, 0.88, 0.10
TRIES, FACTS = 6, 3
_WORD = r"[\p{L}\p{N}_]"
_HINTS = "in|for|with|under|on|about|during"
#: A last comma or semicolon, or a last preposition with a short rest and a head that can stand alone.
PARTS = (r"(?s)^(.*\S)\s*[,;]\s*([^,;]*\S)\z", rf"(?s)^(.{{20,}})\s((?:{_HINTS})\s.{{0,60}})\z")


def draw(seed: int, *slot: Column | str) -> Column:
    """A number from 0 to 2^32 - 1."""
    parts = [F.lit(x) if isinstance(x, str) else x.cast("string") for x in slot]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def one_of(drawn: Column, n: Column | int) -> Column:
    return F.shiftright(drawn * n, 32)


def holds(text: Column, phrase: Column) -> Column:
    """Whether the text has the phrase between words, in any case. An empty or null phrase is nowhere."""
    pattern = F.concat(F.lit(rf"(?i)(?<!{_WORD})\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{_WORD})"))
    there = F.contains(F.lower(text), F.lower(phrase))  # a pattern is made for few rows only
    return F.coalesce((phrase != "") & there & F.rlike(text, pattern), F.lit(False))


def _first(text: Column, change) -> Column:
    return F.concat(change(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def _small(text: Column) -> Column:
    """With a small first letter, unless the second one is a capital, too."""
    return F.when(text.rlike(r"^\p{Lu}(?!\p{Lu})"), _first(text, F.lower)).otherwise(text)


def _told(frame: str, values: dict[str, Column]) -> Column:
    """The frame with its places filled: its own words and columns, one after the other."""
    out = []
    for i, part in enumerate(re.split(r"\{(\w+?)([\^_]?)\}", frame)):
        if i % 3 == 0:
            out.append(F.lit(part))
        elif i % 3 == 1:
            name = part
        else:
            out.append(_first(values[name], F.upper) if part == "^" else _small(values[name]) if part == "_" else values[name])
    return F.concat(*out)


def _clause(parts: Column) -> Column:
    """Parts as one clause: a, b and c."""
    n = F.size(parts)
    return F.when(n <= 1, F.array_join(parts, "")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(parts, -1)))


def _choose(drawn: Column, values: list[Column]) -> Column:
    """One of the columns, by its number: only that one is made."""
    at, out = one_of(drawn, len(values)), values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(at == i, v).otherwise(out)
    return out


def composed(examples: DataFrame, carriers: DataFrame, banks: DataFrame, seed: int = 42, noop: float = NOOP, tries: int = TRIES) -> DataFrame:
    """(example, carrier, position, frame, input, target, needs_persona, facts array<struct<attribute,surface,variants,fragment>>)
    of examples (example), carriers (carrier, text, split_hint, needs_persona, persona_param) and banks (attribute, surface,
    variants). Attributes that are not in WEIGHTS, and null texts and surfaces, are never drawn."""
    carriers = numbered(carriers.where("trim(text) <> ''").select("carrier", "text", "split_hint", "needs_persona", "persona_param"), [], [F.col("carrier"), F.col("text")], "k")
    banks = numbered(banks.where(F.col("attribute").isin(*WEIGHTS) & F.col("surface").isNotNull()).select("attribute", "surface", "variants"), ["attribute"], [F.col("surface")], "k")
    n_carriers = carriers.count()
    sizes = {r["attribute"]: r["n"] for r in banks.groupBy("attribute").agg(F.max("k").alias("n")).collect()}  # a row for each of WEIGHTS at most
    e = F.col("example")
    share = lambda slot: draw(seed, e, slot) / F.lit(2.0**32)

    position = F.element_at(F.array(*map(F.lit, POSITIONS)), (F.pmod(e, F.lit(len(POSITIONS))) + 1).cast("int"))
    many = F.when(share("many") < ONE, 1).when(share("many") < TWO, 2).otherwise(FACTS)
    many = F.when(position == "split", F.greatest(many, F.lit(2))).otherwise(many)
    # The smallest of exponential times whose rates are the weights: weighted picks without replacement.
    times = F.array(*(F.struct((-F.log((draw(seed, e, f"attribute {a}") + 1) / F.lit(2.0**32)) / w).alias("time"), F.lit(a).alias("attribute"), F.lit(sizes[a]).cast("long").alias("n")) for a, w in WEIGHTS.items() if sizes.get(a)))
    base = examples.select("example", position.alias("asked"), (one_of(draw(seed, e, "carrier"), n_carriers) + 1).alias("k"), (share("noop") < noop).alias("noop"), many.alias("many"))
    plan = base.join(carriers.hint("merge"), "k").drop("k")
    if not sizes:
        slots = plan.select("example", F.lit(None).cast("array<struct<slot:int,try:int,attribute:string,surface:string,variants:array<string>,fragment:string>>").alias("drawn")).limit(0)
    else:
        slots = base.where(~F.col("noop")).select("example", F.posexplode(F.slice(F.array_sort(times), 1, F.col("many"))).alias("slot", "a"))
        slots = slots.select("example", "slot", "a.attribute", "a.n", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("try"))
        slots = slots.withColumn("k", one_of(draw(seed, e, F.col("slot"), F.col("try"), "fact"), F.col("n")) + 1).join(banks.hint("merge"), ["attribute", "k"])
        told = F.coalesce(*(F.when(F.col("attribute") == a, _choose(draw(seed, e, F.col("slot"), F.col("try"), "fragment"), [_told(f, {"v": F.col("surface")}) for f in FRAGMENTS[a]])) for a in WEIGHTS))
        slots = slots.groupBy("example").agg(F.array_sort(F.collect_list(F.struct("slot", "try", "attribute", "surface", "variants", told.alias("fragment")))).alias("drawn"))  # at most FACTS x tries
    rows = plan.join(slots.hint("merge"), "example", "left")
    meets = lambda f: holds(F.col("text"), f["surface"]) | F.coalesce(F.exists(f["variants"], lambda v: holds(F.col("text"), v)), F.lit(False))
    free = F.filter("drawn", lambda f: ~meets(f))
    chosen = let(free, lambda x: F.filter(x, lambda f, i: (i == 0) | (F.get(x, i - 1)["slot"] != f["slot"])))
    facts = F.transform(F.coalesce(chosen, F.expr("cast(array() as array<struct<slot:int,try:int,attribute:string,surface:string,variants:array<string>,fragment:string>>)")), lambda f: F.struct(f["attribute"].alias("attribute"), f["surface"].alias("surface"), f["variants"].alias("variants"), f["fragment"].alias("fragment")))
    rows = rows.withColumn("facts", facts)

    text, hint = F.trim("text"), F.col("split_hint")
    has_hint = F.coalesce((hint != "") & F.contains(text, hint), F.lit(False))
    part = lambda i: F.when(has_hint, F.rtrim(F.substring(text, F.lit(1), F.instr(text, hint) - 1)) if i == 1 else F.ltrim(F.substring(text, F.instr(text, hint) + F.length(hint), F.length(text)))).when(text.rlike(PARTS[0]), F.regexp_extract(text, PARTS[0], i)).when(text.rlike(PARTS[1]), F.regexp_extract(text, PARTS[1], i))
    rows = rows.withColumns({"head": part(1), "tail": part(2)})
    bare = F.size("facts") == 0
    astray = (F.col("asked") == "mid_sentence") & F.col("head").isNull() | (F.col("asked") == "split") & (F.size("facts") < 2)
    rows = rows.withColumn("position", F.when(bare, "none").when(astray, "parenthetical").otherwise(F.col("asked")))
    fragments = F.transform("facts", lambda f: f["fragment"])
    rows = rows.withColumns({"all": _clause(fragments), "first": F.coalesce(F.get(fragments, F.lit(0)), F.lit("")), "others": _clause(F.slice(fragments, 2, FACTS))})
    values = {"carrier": text, "facts": F.col("all"), "head": F.col("head"), "tail": F.col("tail"), "first": F.col("first"), "others": F.col("others")}
    drawn = draw(seed, e, "frame")
    framed, number = text, F.lit(-1).cast("long")
    for p in POSITIONS:
        framed = F.when(F.col("position") == p, _choose(drawn, [_told(f, values) for f in FRAMES[p]])).otherwise(framed)
        number = F.when(F.col("position") == p, one_of(drawn, len(FRAMES[p]))).otherwise(number)
    clean = F.regexp_replace(F.regexp_replace(framed, r"\s*([,;:])\s*[,;:]", "$1"), r"\s{2,}", " ")
    filled = F.when(bare, text).otherwise(_first(F.trim(clean), F.upper))
    asked = F.coalesce("persona_param", F.get("facts", F.lit(0))["attribute"])
    param = F.coalesce(*(F.when(asked == a, _choose(draw(seed, e, "parameter"), list(map(F.lit, ps)))) for a, ps in PARAMETERS.items()), _choose(draw(seed, e, "parameter"), list(map(F.lit, PARAMETERS["occupation"]))))
    needs = F.coalesce("needs_persona", F.lit(False)) & ~bare
    out = rows.select("example", "carrier", "position", number.alias("frame"), filled.alias("input"), F.when(needs, F.concat(F.lit("For someone "), param, F.lit(": "), text)).otherwise(text).alias("target"), needs.alias("needs_persona"), "facts")
    out = written(out)  # made once: it is read twice here, and again by whoever counts
    first = out.groupBy(F.sha2("input", 256).alias("__h")).agg(F.min("example").alias("example")).select("example")
    return out.join(first.hint("merge"), "example", "left_semi")


def leaking(examples: DataFrame) -> DataFrame:
    """(example) of those whose target still tells one of their facts."""
    told = F.exists("facts", lambda f: holds(F.col("target"), f["surface"]) | F.coalesce(F.exists(f["variants"], lambda v: holds(F.col("target"), v)), F.lit(False)))
    return examples.where(told).select("example")
