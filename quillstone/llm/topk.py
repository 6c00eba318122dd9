"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector's components, cut into segments. Two codes that differ in at most m(s+1)-1 bits agree,
in one of the m segments, up to s bits. So the search looks up, for growing s, every segment value that differs from a
query's in exactly s bits, verifies the whole codes found, and lets a query go as soon as its k-th verified distance is
at most m(s+1)-1: nothing closer, and no tie, can be missing. All steps are DataFrame operations.

The index holds distinct codes, so copies of a vector meet once; a code brings its k+1 smallest ids, which is all that a
top-k with ties by id can take from it (one may be the query's own).

Defined cases: a null vector is neither found nor searched for; a component that is null or not a number counts as not
positive; a vector shorter or longer than `dim` is read as if filled up with zeros or cut; ids that are null are left
out; repeated ids count once for each code. A query with fewer than k other rows gets them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import materialize


def codes(vectors: DataFrame, id_col: str, vec_col: str, dim: int, width: int) -> DataFrame:
    """(id, code array<int>): the signs in segments of width bits."""
    starts = range(0, dim, width)
    x = vectors[vec_col]

    def segment(at: int) -> Column:
        value = F.lit(0)
        for i in range(at, min(at + width, dim)):
            c = F.get(x, F.lit(i)).cast("double")
            value = value * 2 + F.when((c > 0) & ~F.isnan(c), 1).otherwise(0)
        return value

    return vectors.where(x.isNotNull() & vectors[id_col].isNotNull()).select(vectors[id_col].alias("id"), F.array(*map(segment, starts)).alias("code"))


def _distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, width: int = 16) -> DataFrame:
    """(query_id, rank, neighbor_id, distance) of the k other rows of vectors nearest to each row of queries."""
    if width > 16:
        raise ValueError("segments of more than 16 bits have too many variants")
    segments = -(-dim // width)
    all_codes = materialize(codes(vectors, id_col, vec_col, dim, width).distinct())
    # The k+1 smallest ids of each code: first within hash parts, so that a code with very many ids is no single task.
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    by_part = Window.partitionBy("code", "part").orderBy("id")
    by_code = Window.partitionBy("code").orderBy("id")
    few = all_codes.withColumn("part", part).withColumn("r", F.row_number().over(by_part)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k + 1)
    index = materialize(few.groupBy("code").agg(F.collect_list("id").alias("ids")))
    by_segment = materialize(index.select("code", F.posexplode("code").alias("seg", "value")))
    wanted = materialize(codes(queries, id_col, vec_col, dim, width).distinct().withColumnsRenamed({"id": "query_id", "code": "query"}))
    nearest = Window.partitionBy("query_id", "query").orderBy("distance", "id")
    best, open_queries = None, wanted
    for s in range(width + 1):
        # Every choice of s bits of the segment, one after the other in rising order.
        probes = open_queries.select("query_id", "query", F.posexplode("query").alias("seg", "value")).withColumn("bit", F.lit(-1))
        for _ in range(s):
            probes = probes.where(F.col("bit") < width - 1).select("query_id", "query", "seg", "value", F.explode(F.expr(f"sequence(bit + 1, {width - 1})")).alias("bit"))
            probes = probes.withColumn("value", F.expr("value ^ shiftleft(1, bit)"))
        # Row estimates know nothing of the explosion: without the hint the larger side would be broadcast.
        met = probes.hint("merge").join(by_segment, ["seg", "value"]).select("query_id", "query", "code").distinct()
        found = met.hint("merge").join(index, "code").select("query_id", "query", _distance("query", "code").alias("distance"), F.explode("ids").alias("id")).where("id <> query_id")
        pool = found if best is None else best.drop("rank").unionByName(found).distinct()
        best = materialize(pool.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k))
        covered = segments * (s + 1) - 1
        if covered >= dim:
            break
        done = best.groupBy("query_id", "query").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).where((F.col("n") == k) & (F.col("kth") <= covered))
        open_queries = materialize(open_queries.join(done, ["query_id", "query"], "left_anti"))
        if open_queries.isEmpty():
            break
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), F.col("distance").cast("int").alias("distance"))
