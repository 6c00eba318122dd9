"""Source divergence audit: how the term shares of the sources of a language differ, as plain relations.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. Each language keeps the terms of at least
`least` of its documents. Every (language, source) group and every language gives each kept term a smoothed share in
billionths, also where the group never has it, so groups are crossed with the kept vocabulary. Two sources of a language
differ by the sum of the differences of their shares (part `pair`); a source's own terms are those of a greater share
than in the language (part `term`).

A row of the input is one document. A text's terms are sorted within the row, so that one pass counts occurrences and
documents, and both are summed before anything is shuffled: a language or source of any size costs each task one row a
term. Groups meet the vocabulary under salts of the term, not under the language alone.

Defined cases: null text, language or source is the empty string; texts without terms, however long, and groups of such
texts only count as groups (all shares are those of count 0); ids play no part, so null and repeated ones need no care;
repeated rows are so many documents; an empty table gives an empty result; ties are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize

# Fixed value: the pattern of a term, `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`, as it reads once A-Z are in lower case.
TERM = r"[a-z\x{80}-\x{10FFFF}]+"
BILLION = 1_000_000_000
SMOOTHING = 5


def _terms(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.sort_array(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0)))


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the group's documents that have it. A group
    without terms has one row of null term."""
    group = [F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*group, _terms(docs[text_col]).alias("terms"))
    # Beside each term of the sorted list stands the one before it; a document's first of equal terms counts the document.
    beside = F.inline(F.arrays_zip("terms", F.concat(F.array(F.lit("")), "terms")))
    each = rows.select("lang", "source", beside).toDF("lang", "source", "term", "before").where("term IS NOT NULL OR before = ''")
    return each.groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.count(F.when(F.col("term") != F.col("before"), 1)).alias("docs"))


def _share(count: str, total: str, vocabulary: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 V)), in whole numbers of any size."""
    return F.expr(f"1 + (CAST({BILLION} AS DECIMAL(10, 0)) * CAST({count} + {SMOOTHING} AS DECIMAL(20, 0))) div CAST({total} + {SMOOTHING} * {vocabulary} AS DECIMAL(20, 0))")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank), as above; `pair` has all ranks, `term` those to `top`."""
    salts = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(counts(docs, text_col, lang_col, source_col))
    kept = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "lang_n")
    kept = materialize(kept)
    known = materialize(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = found.groupBy("lang", "source").agg(F.count("*")).select("lang", "source")
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0))  # a row for each group

    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    crossed = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).join(salted, ["lang", "salt"])
    dense = crossed.join(known, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = materialize(dense.select("lang", "source", "term", "n", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q")))

    one, two = dense.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa")), dense.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    apart = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    left, right = groups.select("lang", F.col("source").alias("a")), groups.select("lang", F.col("source").alias("b"))
    pairs = left.join(right, "lang").where("a < b").join(apart, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    pairs = pairs.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(in_order)).withColumn("part", F.lit("pair"))
    terms = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
