"""Splits, samples and keyed picks. Seeded choices order rows by md5(id:seed), so every engine makes the same ones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.running import numbered


def seeded_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def stratified(rows: DataFrame, id_col: str, stratum: str, seed: int = 42, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(id, stratum, split): each stratum is cut by its seeded order; a stratum of three or more keeps one row at least
    for val and for test, smaller ones go to train first. Shares are taken as the decimals they are written as, halves round up
    (0.7 of 45 rows are 32, where doubles give 31.499). Places in a stratum are running counts: no stratum is one task."""
    sizes = rows.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    ordered = numbered(rows.select(id_col, stratum, seeded_key(id_col, seed).alias("__o")), [stratum], [F.col("__o"), F.col(id_col)], "__k")
    rows = ordered.join(sizes, F.col(stratum).eqNullSafe(F.col("__s")))
    part = lambda share: F.round(F.col("__n") * F.lit(Decimal(str(share))), 0).cast("long")
    a, b = F.greatest(F.lit(1), part(train)), part(val)
    tight = (a + b >= F.col("__n")) & (F.col("__n") >= 3)
    a, b = F.when(tight, F.col("__n") - 2).otherwise(a), F.when(tight, 1).otherwise(b)
    split = F.when(F.col("__k") <= a, "train").when(F.col("__k") <= a + b, "val").otherwise("test")
    return rows.select(id_col, stratum, split.alias("split"))


def seeded_sample(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return rows.orderBy(seeded_key(id_col, seed), id_col).limit(n)


def first_write(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key; a partial aggregate, so a key with very many rows is no single task."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("__r")).select(key, "__r.*")


def last_write(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), order).alias("__r")).select(key, "__r.*")


def oldest_beyond(rows: DataFrame, cap: int, order: Column) -> DataFrame:
    """The rows that must go so that `cap` stay: all but the last `cap` in the order. The cap bounds what is sorted out."""
    kept = rows.orderBy(order.desc()).limit(cap)
    return rows.join(kept.select(*(F.col(c).alias(f"__{c}") for c in rows.columns)), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in rows.columns], "left_anti")


def cyclic(rows: DataFrame, order: str, n: int) -> DataFrame:
    """(i, row): numbers below n take the rows in turn. Row numbers come from range partitions and their counts, so the
    rows are never in one task."""
    spark = rows.sparkSession
    numbered = numbered_rows(rows, order)
    total = F.broadcast(rows.agg(F.count("*").alias("__n")))  # one row
    numbers = spark.range(n).select(F.col("id").alias("i")).join(total).select("i", (F.col("i") % F.col("__n")).alias("__k"))
    return numbers.join(numbered, "__k").drop("__k")


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with __k, their number from 0 in the order."""
    return numbered(rows, [], [F.col(order)], "__k").withColumn("__k", F.col("__k") - 1)
