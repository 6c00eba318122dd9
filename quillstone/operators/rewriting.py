"""Rewrites without a model: persona pruning, candidate sets and the choice among candidates. Pruning
runs in Arrow batches, all else as column expressions; a model is plugged in as a column (scores, similarity, a rewrite) made by any pandas UDF."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quillstone.functions import patterns as P
from quillstone.functions import privacy as V
from quillstone.functions import text as T


_RULES = {
    "veto": re.compile(P.DISCLOSURE_VETO, re.I),
    "says": re.compile("|".join(f"(?:{p})" for p in P.DISCLOSURE), re.I),
    "paren": re.compile(P.CLOSING_PAREN),
    "break": re.compile(P.SENTENCE_BREAK),
    "back": re.compile(P.BACK_REFERENCE, re.I),
    "lead": re.compile(P.LEADING_CLAUSE),
    "inner": re.compile(P.EMBEDDED_CLAUSE),
    "trail": re.compile(P.TRAILING_CLAUSE),
}


#: Strings of which each match of a pattern holds one, in small letters.
_NEEDED = {"back": T.needles(P.BACK_REFERENCE), "trail": T.needles(P.TRAILING_CLAUSE)}
_AS = re.compile(r"as\s+[a\d]").search
_ODD = str.maketrans("\u017f\u0131\u0130", "sii")


def _folded(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_ODD).lower()


def _may(rule: str, low: str) -> bool:
    return any(x in low for x in _NEEDED[rule])


def _discloses(sentence: str) -> bool:
    s = sentence.strip()
    return "?" not in s and not _RULES["veto"].search(s) and bool(_RULES["says"].search(s))


def prune_text(text: str | None) -> str:
    """The text without autobiographical framing. In turn go: a closing parenthesis about the author; disclosing sentences
    in front (unless a later one refers back to them) and behind, one sentence always staying; an opening clause before
    the request; a clause inside that something follows; a closing remark. What is left starts with a capital if anything
    went."""
    start = out = (text or "").strip()
    if (m := _RULES["paren"].search(out)) and (_discloses(m[1]) or any(w in m[1].lower() for w in P.PAREN_WORDS)):
        out = out[: m.start()].strip()
    parts = [p.strip() for p in _RULES["break"].split(out) if p.strip()]
    refers = _may("back", _folded(out)) and any(_RULES["back"].search(p) for p in parts[1:])
    low, high = 0, len(parts)
    while not refers and high - low > 1 and _discloses(parts[low]):
        low += 1
    while high - low > 1 and _discloses(parts[high - 1]):
        high -= 1
    out = " ".join(parts[low:high])
    out = _RULES["lead"].sub(r"\1\2", out).strip()
    low = _folded(out)
    if not refers and _AS(low) and (m := _RULES["inner"].search(out)) and (rest := out[m.end() :].lstrip(",; ")):
        out = ", ".join(x for x in (out[: m.start()].rstrip(",; "), rest) if x)
    out = _RULES["trail"].sub("", out).strip() if _may("trail", low) else out
    return out[0].upper() + out[1:] if out and out != start else out


@F.pandas_udf(StringType())
def pruned(texts: pd.Series) -> pd.Series:
    return texts.map(prune_text)


_LETTER = re.compile("[a-z]").search
_NOT_A, _NOT_B = frozenset(P.NEGATIONS_A), frozenset(P.NEGATIONS_B)


def _counts(words: str | None, first: Counter | None) -> tuple[Counter, dict]:
    """The tokens of a text, which blanks part, with what utility and degeneracy ask of them, and how they meet the first."""
    own = Counter(words.split(" ")) if words else Counter()
    shared = own.keys() & first.keys() if first is not None else own.keys()
    other = own if first is None else first
    dot = sum(own[w] * other[w] for w in shared)
    length = sqrt(sum(n * n for n in other.values())) * sqrt(sum(n * n for n in own.values()))
    return own, {
        "n": own.total(), "distinct": len(own), "bare": sum(n for w, n in own.items() if not _LETTER(w)), "not_a": len(_NOT_A & own.keys()),
        "not_b": len(_NOT_B & own.keys()), "shared": len(shared), "cosine": dot / length if length else 0.0,
    }


_COUNTS = StructType([StructField(n, IntegerType()) for n in ("n", "distinct", "bare", "not_a", "not_b", "shared")] + [StructField("cosine", DoubleType())])


def _each(texts: list | None) -> list[dict] | None:
    if texts is None:
        return None
    first, out = _counts(texts[0], None)
    return [out, *(_counts(x, first)[1] for x in texts[1:])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the last column, lists of texts as tokens that blanks part, as lists of their counts."""
    numbers = pa.list_(pa.struct([(f.name, pa.float64() if f.name == "cosine" else pa.int32()) for f in _COUNTS]))
    for b in batches:
        found = pa.array([_each(x) for x in b.column(b.num_columns - 1).to_pylist()], numbers)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], names=b.schema.names)


def with_counts(rows: DataFrame, name: str, first: Column, others: Column) -> DataFrame:
    """rows with counts of a text and of an array of texts, in this order: tokens, distinct ones, those without a letter a
    to z, negations, and what each shares with the first text."""
    words = lambda x: F.array_join(T.tokens(x), " ")
    rows = rows.withColumn(name, F.concat(F.array(words(first)), F.transform(others, words)))
    return rows.mapInArrow(_counted, StructType([*rows.schema.fields[:-1], StructField(name, ArrayType(_COUNTS))]))


def utility_of(pair: Column) -> Column:
    """The utility of T.utility, from counts of a text and its rewrite."""

    def of(o: Column, r: Column) -> Column:
        differ = o["not_a"] != r["not_a"]
        (forward, c1), (backward, c2) = T.entailment_a_by(r["shared"], r["distinct"], differ), T.entailment_a_by(r["shared"], o["distinct"], differ)
        return T.composite(r["cosine"], forward, backward, F.greatest(c1, c2), T.degeneracy_by(o, r))

    return of(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))


def _steps(rows: DataFrame, text: str) -> DataFrame:
    """rows with the texts that candidates are made of, each a column of its own, so that none is evaluated again by the
    ones that follow: scrubbed, pruned, general, more general, tagged, neutral."""
    t, c = F.col(text), F.col
    out = rows.withColumns({"__base": V.scrubbed(t)[0], "__p": pruned(t)}).withColumn("__p", V.scrubbed(c("__p"))[0])
    for name, start, rules in (("__g", "__base", P.GENERAL), ("__m", "__g", P.MORE_GENERAL), ("__t", "__base", P.PLACEHOLDERS)):
        out = out.withColumn(name, T.squeezed(T.chain(c(start), rules)) if name == "__g" else F.trim(T.chain(c(start), rules)))
    out = out.withColumn("__n", c("__base"))
    for a in P.ATTRIBUTES:
        out = out.withColumn("__n", V.neutral(c("__n"), a))
    return out.withColumn("__good", T.degeneracy(t, c("__g")).isNull())


_MADE = ("__base", "__p", "__g", "__m", "__t", "__n", "__good")


def _plain(text: str) -> list:
    """The candidates in order; those that do not apply are null."""
    t, c = F.col(text), F.col
    good = lambda x: F.when(c("__good"), x)
    return [
        F.when((F.lower("__p") != F.lower(F.trim(t))) & (F.length("__p") >= 10), c("__p")), c("__g"), c("__m"),
        F.trim(T.replaced(c("__m"), r"\ban adult\b", "someone", ignore_case=True)), F.when(c("__t") != c("__base"), c("__t")), good(T.squeezed(c("__n"))),
        good(F.trim(T.chain(c("__base"), P.AGE_AND_ROLE))), good(F.trim(T.chain(c("__base"), P.ROLE_AND_SCHOOL))),
    ]


def _listed(rows: DataFrame, found: list) -> DataFrame:
    return rows.withColumn("candidates", F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull() & (F.trim(x) != ""))))


def with_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with candidates, an array of distinct rewrites in order: pruned, general, more general, plain, tagged,
    neutral, by age and role, by role and school. A degenerate general rewrite ends the list before the neutral one."""
    return _listed(_steps(rows, text), _plain(text)).drop(*_MADE)


def with_diverse_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with candidates: rewrites in several registers (pruned from the scrubbed text, formal, casual, subordinate,
    natural), then those of with_candidates."""
    c = F.col
    out = _steps(rows, text).withColumn("__ps", pruned(c("__base"))).withColumn("__f", T.squeezed(T.chain(c("__n"), P.FORMAL)))
    first = F.when((F.lower("__ps") != F.lower(F.trim("__base"))) & (F.length("__ps") >= 10), c("__ps"))
    opening = F.concat(F.lit(P.SUBORDINATE_OPENING), F.lower(F.substring("__f", 3, 1)), F.substring("__f", 4, 1 << 30))
    own = [first, c("__f"), T.squeezed(T.chain(c("__base"), P.CASUAL)), F.when(F.lower("__f").startswith("i ") & (F.length("__f") > 2), opening), T.squeezed(T.chain(c("__base"), P.NATURAL))]
    return _listed(out, own + _plain(text)).drop(*_MADE, "__ps", "__f")


def with_best(rows: DataFrame, text: str = "text", most_risk: float = 0.30, least_cosine: float = 0.82) -> DataFrame:
    """rows, which have candidates, with rewrite, engine, cosine and kept. Of the candidates that differ, are not
    degenerate, leave no identifier, are below the risk and close enough, the most useful one is taken, the first of
    equals; without one, the redacted text (engine redaction, no cosine). kept counts the candidates that pass. All of it
    happens in the row: tokens are made once for the text and once for a candidate, and counted in one Arrow batch."""
    arr, own = F.col("__c"), F.get("__k", F.lit(0))
    other = F.filter(F.transform("candidates", lambda c, i: F.struct(c.alias("cand"), i.alias("i"))), lambda x: F.trim(x["cand"]) != F.trim(F.col(text)))
    rows = rows.withColumn("__c", other)
    rows = with_counts(rows, "__k", F.col(text), F.transform(arr, lambda x: x["cand"]))
    near = F.transform(arr, lambda x, i: F.struct(x["cand"].alias("cand"), x["i"].alias("i"), F.get("__k", i + 1).alias("k")))
    # The tests come in the order of what they cost; a candidate that fails one is spared the others.
    sound = lambda x: (F.round(x["k"]["cosine"], 4) >= least_cosine) & T.degeneracy_by(own, x["k"]).isNull() & ~V.identified(x["cand"]) & (V.overall_score(x["cand"]) < most_risk)

    def worth(x):
        r = x["k"]
        entailed = T.entailment_b_by(r["shared"], own["distinct"], r["distinct"], own["not_b"] != r["not_b"])["composite"]
        return F.struct((-F.round(0.6 * r["cosine"] + 0.4 * entailed, 4)).alias("o"), x["i"].alias("i"), x["cand"].alias("cand"), F.round(r["cosine"], 4).alias("cos"))

    rows = rows.withColumn("__c", F.transform(F.filter(near, sound), worth))
    rows = rows.withColumn("__b", F.array_min(arr))
    taken = F.col("__b").isNotNull()
    return rows.withColumns({
        "rewrite": F.when(taken, F.col("__b")["cand"]).otherwise(V.redacted(F.col(text))), "engine": F.when(taken, "heuristic").otherwise("redaction"),
        "cosine": F.col("__b")["cos"], "kept": F.size("__c"),
    }).drop("__k", "__c", "__b")


def selected(messages: DataFrame, key: list[str], text: str = "text", most_risk: float = 0.30, least_cosine: float = 0.82) -> DataFrame:
    """(key, rewrite, engine) of the best candidate of each message."""
    rows = with_candidates(messages.select(*key, F.coalesce(F.col(text), F.lit("")).alias("text")))
    return with_best(rows, "text", most_risk, least_cosine).select(*key, "rewrite", "engine")
