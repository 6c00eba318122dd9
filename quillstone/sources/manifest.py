"""Splits as JSON lines with a manifest: which files a split has, their digests and their rows.

A split has as many files as its size asks for, each of a bounded number of rows, so a digest is made in a task that
holds one file. The manifest is a table beside the splits; a reader compares what is there with it, file by file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_A_FILE = 100_000
SCHEMA = "split string, file string, sha256 string, rows long, seed int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, sha256, rows) of the data files under path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/data")
    lines = F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n")).cast("long")
    return found.select(F.url_decode(F.regexp_extract("path", r"/split=([^/]*)/[^/]*$", 1)).alias("split"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"), lines.alias("rows"))


def write(rows: DataFrame, path: str, split: str = "split", seed: int = 42) -> None:
    """rows as JSON lines, a folder for each value of `split`, and their manifest."""
    rows.withColumnRenamed(split, "split").write.option("maxRecordsPerFile", ROWS_A_FILE).partitionBy("split").json(f"{path}/data")
    _files(rows.sparkSession, path).withColumn("seed", F.lit(seed)).write.json(f"{path}/manifest")


def listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(f"{path}/manifest")


def compared(spark: SparkSession, path: str) -> DataFrame:
    """(split, file, state, rows): each file of the manifest or of the folder is same, changed, missing or extra."""
    want = listed(spark, path).select("split", "file", F.col("sha256").alias("want"), "rows")
    have = _files(spark, path).select("split", "file", F.col("sha256").alias("have"))
    state = F.when(F.col("want").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("want") != F.col("have"), "changed").otherwise("same")
    return want.join(have, ["split", "file"], "full").select("split", "file", state.alias("state"), "rows")


def gates(spark: SparkSession, path: str) -> DataFrame:
    """(split, gate, files, rows, reasons): a split is READY if each of its files is as listed."""
    by = compared(spark, path).groupBy("split").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), *(F.count_if(F.col("state") == s).alias(s) for s in ("changed", "missing", "extra")))
    reasons = F.array_compact(F.array(*(F.when(F.col(s) > 0, F.concat(F.lit(f"{s} "), F.col(s).cast("string"))) for s in ("changed", "missing", "extra"))))
    return by.select("split", F.when(F.size(reasons) > 0, "BLOCKED").otherwise("READY").alias("gate"), "files", "rows", F.array_join(reasons, ", ").alias("reasons"))


def read(spark: SparkSession, path: str, split: str, schema: T.StructType | str, seed: int | None = None, held_out: tuple[str, ...] = ("test",)) -> DataFrame:
    """The records of a split whose files are as listed. Held-out splits are refused, and so are others than of the seed."""
    if split in held_out:
        raise PermissionError(f"the split {split} is held out")
    own = listed(spark, path).where(F.col("split") == split)
    facts = own.agg(F.count("*").alias("n"), F.count_if(F.col("seed") != F.lit(seed)).alias("other")).first()
    if not facts["n"]:
        raise ValueError(f"the manifest lists no split {split}")
    if seed is not None and facts["other"]:
        raise ValueError(f"the split {split} is not of seed {seed}")
    bad = compared(spark, path).where((F.col("split") == split) & (F.col("state") != "same")).orderBy("file").first()
    if bad is not None:
        raise ValueError(f"{split}/{bad['file']} is {bad['state']}")
    return spark.read.schema(schema).json(f"{path}/data/split={split}")
