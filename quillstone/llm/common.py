"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
_UPPER = {c: c + 32 for c in range(65, 91)}
_SPACES = {c: 32 for c in range(9, 14)}
_FOLD = _UPPER | _SPACES


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for a context, and keep Arrow batches small: a batch is held both by the
    JVM and by the worker, and texts can be long."""
    sc = spark.sparkContext
    if getattr(sc, "_quillstone_shipped", None) is None:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="quillstone-")) / "quillstone-package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._quillstone_shipped = True
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where none is named and driver and executors
    are one process, as elsewhere each executor would write to its own disk and later reads would miss those files."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillstone-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs no
    recomputation. The files go when the session ends. As nothing needs the shuffles behind df any more, a collection is
    asked for, upon which Spark deletes their files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    gc.collect()
    jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept on the executors' disks. Lineage stays, so what a lost executor held is computed again;
    for loops, whose lineage would grow, use materialize."""
    return df.persist(StorageLevel.DISK_ONLY)


def fold(text: str) -> str:
    """Lower-case A-Z and turn the six ASCII white-space bytes into blanks."""
    return text.translate(_FOLD)


def words(text: str | None) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; null has none."""
    if not text:
        return []
    return [w for w in text.translate(_FOLD).split(" ") if w]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """The same words as UTF-8: splitting bytes at white space splits at just those six bytes."""
    return text.encode().translate(_LOWER).split() if text else []


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null is empty."""
    return [t or "" for t in column.to_pylist()]


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo; null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def below_share(hash64: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash lies in the lowest share of its range. A share of any size above 2^-64 keeps that many of the
    rows: unlike a remainder by a small number it never comes down to nothing or to one class."""
    edge = F.lit(2.0) ** 63 * (2 * (share if isinstance(share, Column) else F.lit(share)) - 1)
    return hash64.cast("double") <= edge


def batches(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def concat_bytes(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the offsets at which each text begins (one more entry at the end)."""
    items = list(texts)
    offsets = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) for x in items], out=offsets[1:])
    return np.frombuffer(b"".join(items), np.uint8), offsets
