"""Running sums and row numbers in an order, for groups of any size: no group is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.tables import written


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with a column for each of sums: the sum over the rows of the same group up to this one, in the order, which must
    be whole (no ties) for a defined result. Rows are dealt by ranges of group and order and written as dealt; each range
    adds up by itself, and what the ranges before it hold, a row for each range and group in it, is joined. Null is a
    group of its own."""
    names = {n: f"__s{i}" for i, n in enumerate(sums)}
    dealt = rows.select("*", *(c.alias(names[n]) for n, c in sums.items())).repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id())
    dealt = written(dealt)
    within = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__p", *by).agg(*(F.sum(names[n]).alias(names[n]) for n in sums))
    before = sizes.select(F.col("__p").alias("__q"), *(F.col(c).alias(f"__g{i}") for i, c in enumerate(by)), *(F.coalesce(F.sum(names[n]).over(earlier), F.lit(0)).alias(f"__b{i}") for i, n in enumerate(sums)))
    local = dealt.select(*rows.columns, "__p", *(F.sum(names[n]).over(within).alias(names[n]) for n in sums))
    same = [local["__p"] == before["__q"], *(local[c].eqNullSafe(before[f"__g{i}"]) for i, c in enumerate(by))]
    before = before if by else F.broadcast(before)  # a row for each range
    return local.join(before, same).select(*rows.columns, *((F.col(names[n]) + F.col(f"__b{i}")).alias(n) for i, n in enumerate(sums)))


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """rows with their number from 1 in their group's order."""
    return running(rows, by, order, {name: F.lit(1).cast("long")})
