"""Curation of rewrites: candidate choice, verdicts, quotas, gates and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.functions import text as T
from quillstone.operators.splits import seeded_key


def best_candidate(candidates: DataFrame, key: str, order: Column) -> DataFrame:
    """The candidate with the smallest order of each key, as a partial aggregate."""
    rest = F.struct(*(c for c in candidates.columns if c != key))
    return candidates.groupBy(key).agg(F.min_by(rest, order).alias("__c")).select(key, "__c.*")


def pareto_score(drop: Column, entailment: Column, similarity: Column, length_penalty: Column) -> Column:
    return 0.45 * drop + 0.40 * entailment + 0.15 * similarity - 0.10 * length_penalty


def verdict(before: Column, after: Column, hard_left: Column, utility: Column, floor: float = P.UTILITY_FLOOR) -> tuple[Column, Column]:
    """(risk delta, verdict). Identifiers that are left override everything; then the change of risk decides, then the
    cost in utility (null: no cost known)."""
    delta = F.round(before - after, 4)
    flat = F.when(delta >= -0.01, "no_change").otherwise("worse")
    out = F.when(hard_left > 0, "explicit_pii_remains").when(delta <= 0.01, flat).when(F.coalesce(utility, F.lit(1.0)) < floor, "improved_with_cost").otherwise("improved")
    return delta, out


def identity_quota(accepted: DataFrame, unchanged: DataFrame, share: float, seed: int, id_col: str = "id") -> DataFrame:
    """As many unchanged rows, by seeded order, as make up `share` of them and the accepted rows together. The quota, a
    number, reaches the driver; the rows do not."""
    n = int(accepted.count() * share / (1 - share) + 0.5)
    return unchanged.orderBy(seeded_key(id_col, seed), id_col).limit(n)


def content_hash(rows: DataFrame, by: str, order: str, content: Column) -> DataFrame:
    """(by, digest): SHA-256 of a group's lines in order, joined by line breaks. The digest is defined over the whole
    ordered text, so a group must fit a task; it is meant for manifests of splits."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), content.alias("c")))), lambda x: x["c"])
    return rows.groupBy(by).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


# Limits of the acceptance gate.
MOST_CONTRADICTION, LEAST_ENTAILMENT, LEAST_COSINE = 0.2, 0.5, 0.5


def judged(rows: DataFrame, original: str, candidate: str, runs: str) -> DataFrame:
    """rows with reason: the first gate a candidate fails, or null if it is accepted. runs: the token runs (arrays) that
    must not appear in it. Gates in order: empty, unchanged, degenerate, leak, contradiction, drifted (neither entailed nor
    close). Every part is a column of its own, so none is evaluated twice."""
    a, b = F.col(original), F.col(candidate)
    forward, c1 = T.entailment_a(a, b)
    _, c2 = T.entailment_a(b, a)
    words = T.alnum_tokens(b)
    parts = {
        "__deg": T.degeneracy(a, b), "__leak": F.exists(F.col(runs), lambda r: T.contains_run(words, r)), "__f": forward,
        "__c": F.greatest(c1, c2), "__cos": T.token_cosine(a, b), "__same": T.squeezed(a) == T.squeezed(b),
    }
    out = rows.withColumns(parts)
    drifted = (F.col("__f") < LEAST_ENTAILMENT) & (F.col("__cos") < LEAST_COSINE)
    reason = (
        F.when(F.trim(F.coalesce(b, F.lit(""))) == "", "empty").when(F.col("__same"), "unchanged")
        .when(F.col("__deg").isNotNull(), F.concat(F.lit("degenerate:"), "__deg")).when(F.col("__leak"), "leak")
        .when(F.col("__c") > MOST_CONTRADICTION, "contradiction").when(drifted, "drifted")
    )
    return out.withColumn("reason", reason).drop(*parts)


def negatives(target: Column, source: Column, attribute: Column) -> Column:
    """array<struct<kind,text>> of poor rewrites of a preference pair, those that differ from the good one: cut short
    (at a clause of four words or more, else a text of twelve words in its middle), leaking (the source itself), and with
    a tag in the place of an own word, or before the text."""
    t = F.trim(target)
    close = F.when(F.contains(t, F.lit("?")), "?").otherwise(".")
    first = F.trim(F.get(F.split(t, P.NEGATIVE_CLAUSE), F.lit(0)))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    clause = F.when(first.rlike(r"[?.]$"), first).otherwise(F.concat(first, close))
    several = F.size(F.filter(F.split(first, r"\s+"), lambda w: w != "")) >= 4
    half = F.concat(F.array_join(F.slice(words, F.lit(1), (F.size(words) / 2).cast("int")), " "), close)
    cut = F.when((first != t) & several & (clause != t), clause).when(F.size(words) >= 12, half)
    tag = F.concat(F.lit("["), F.upper(attribute), F.lit("]"))
    tagged = F.trim(F.regexp_replace(t, F.lit(P.NEGATIVE_OWN_WORD), tag))
    marked = F.when(tagged != t, tagged).otherwise(F.concat(tag, F.lit(": "), t))
    kinds = zip(P.NEGATIVE_KINDS, (cut, F.trim(source), marked), strict=True)
    return F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("text")) for k, x in kinds)), lambda n: n["text"].isNotNull() & (n["text"] != t))
