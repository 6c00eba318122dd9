"""The corpus pipeline: five stages over the documents table, each calling one operator of quillstone.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes every stage's result
as a table and reads it again. All stages but the last return the columns of documents.

1. quality: documents that the classifier rejects (score below 0.3) go. Empty texts get the model's bias as their score.
2. lines: later near copies of lines, short ones too, go from the texts; only blank lines are left out. The documents
   stay, if need be with an empty text.
3. near_duplicates: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.
   Candidates are SimHash fingerprints of the shingles that one-wildcard variants connect, and what a prefix index adds;
   all are verified on the sets. Of each group of linked ones the document with the smallest id stays; ties go by the
   text's hash, and rows that are equal in id and text count once. Documents without words are one group.
4. repeats: substrings of 200 bytes or more that occur more than once go from the texts; the documents stay.
5. packing: what is left is packed into sequences of 2048 tokens.

n_chars, where the table has it, follows the text. ORACLE_SQL is None: the shingle sets, the classifier and the packing
are not expressible in SQL, so the stages are tested against brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import lines, packing, quality, repeats, shingles
from quillstone.llm.common import materialize, ship, table

ORACLE_SQL = None
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars after a change of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, as_filter=0.3)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _sized(lines.dedup_lines(docs, threshold=0.8, min_words=1).select(*docs.columns))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return shingles.representatives(docs, shingle=5, threshold=0.8)


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _sized(repeats.remove_repeats(docs, length=200))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, VOCABULARY, size=2048, end_id=1)


STAGES = [
    ("quality", stage_quality),
    ("lines", stage_lines),
    ("near_duplicates", stage_near_duplicates),
    ("repeats", stage_repeats),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents table of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
