"""Tables in the folder that all executors share: intermediate results that end lineage, and versions of kept state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir). One of our own only where driver and executors
    are one process: elsewhere each executor would write to its own disk, and later reads would miss those files."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
    return f"{base}/quillstone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: rows stay where they are dealt, whatever runs again. The files go when
    the session ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
