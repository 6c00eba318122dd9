"""Readers and writers of the record formats, with declared schemas; bad lines are kept aside, not thrown away."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE = T.StructType([T.StructField("estimate", T.StringType()), T.StructField("hardness", T.IntegerType()), T.StructField("certainty", T.IntegerType())])
PROFILE = T.StructType([T.StructField(n, T.StringType()) for n in ("age", "sex", "city_country", "birth_city_country", "education", "occupation", "income", "income_level", "relationship_status")])
COMMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "author", "profile_id", "username", "user_id", "thread_id", "text", "comment", "body")]
    + [
        T.StructField("profile", PROFILE),
        T.StructField("reviews", T.StructType([T.StructField("human", T.MapType(T.StringType(), ATTRIBUTE))])),
        T.StructField("guesses", T.ArrayType(T.StructType([T.StructField("feature", T.StringType()), T.StructField("hardness", T.IntegerType()), T.StructField("model_eval", T.ArrayType(T.DoubleType()))]))),
    ]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = COMMENT, strict: bool = False) -> DataFrame:
    """Records of JSON lines; blank lines are skipped. A line that is no JSON is in _corrupt, or with strict an error."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    both = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(both).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_json_file(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_directory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All .json and .jsonl files of a folder, with the file each record is from."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "*.{json,jsonl}").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_usage_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV log by declared columns: short rows are filled up with nulls."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return found


def author_id():
    """First of the id fields that is not blank."""
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return F.coalesce(*map(blank, ("profile_id", "author", "username", "user_id")))


def message_text():
    return F.coalesce("text", "comment", "body")


def inferable(attribute: str):
    """1.0 where a human reader's estimate is not blank."""
    return F.when(F.trim(F.coalesce(F.col("reviews.human")[attribute]["estimate"], F.lit(""))) != "", 1.0).otherwise(0.0)


def verified(spark: SparkSession, path: str, sha256: str, schema: T.StructType = COMMENT) -> DataFrame:
    """A split file whose bytes have this digest; a split named test is refused. Spark reads the bytes, so the file may be in
    any store it knows; the digest is over the whole file, which must fit a task."""
    if "test" in path.rsplit("/", 1)[-1].split("."):
        raise PermissionError("the held-out split is not for training")
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first()
    if found is None or found["d"] != sha256:
        raise ValueError(f"{path} has digest {found and found['d']}, not {sha256}")
    return read_jsonl(spark, path, schema)


def first_source(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists, in whatever store it is: a local copy, a raw one, a cached one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def flat_records(rows: DataFrame, most: int = 2000) -> DataFrame:
    """Nested columns as JSON text, and every text column cut to `most` characters (the width of the flat record format)."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    out = []
    for f in rows.schema:
        c = F.to_json(F.col(f.name)) if isinstance(f.dataType, nested) else F.col(f.name)
        out.append((F.substring(c, 1, most) if isinstance(f.dataType, (*nested, T.StringType)) else c).alias(f.name))
    return rows.select(*out)


def append_whole(rows: DataFrame, path: str) -> None:
    """rows added to a JSON log: the commit protocol of the file sink shows either all of them or none."""
    rows.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    rows.write.partitionBy(split).mode("errorifexists").json(path)


def flattened(summary: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(dotted name, value) rows of a nested summary; lists as JSON."""
    import json

    out = []
    for k, v in summary.items():
        name = f"{prefix}.{k}" if prefix else str(k)
        out += flattened(v, name) if isinstance(v, dict) else [(name, json.dumps(v) if isinstance(v, (list, tuple)) else "" if v is None else str(v))]
    return out
