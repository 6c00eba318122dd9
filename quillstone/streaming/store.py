"""A table of open sessions that a stream keeps: versioned, with an idle limit and a cap on how many stay.

Each micro-batch makes a new version from the one before it and the batch's events. Sessions idle for longer than `ttl`
go first, then, while more than `cap` are left, those least recently seen; equals go by session. Which ones these are
is found by counting: histograms of the last times narrow down to the time at which the cap is met, so no task sorts or
holds all sessions. A version is complete once its files are committed, and a batch that runs again after a failure
writes the same version again from the same predecessor, so each event counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session long, events long, last_seen long, version long"
BUCKETS = 1024


def oldest(sessions: DataFrame, n: int, time: str = "last_seen", session: str = "session") -> Column | None:
    """A condition that holds for the n rows of the smallest (time, session). None for no rows. Time and session are whole
    numbers. Each round counts the rows of at most BUCKETS ranges."""

    def bound(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
        """The n-th smallest value, counted from 1, and how many rows lie below it."""
        low, high = rows.agg(F.min(column), F.max(column)).first()
        below = 0
        while low < high:
            width = -(-(high - low + 1) // BUCKETS)
            place = F.expr(f"CAST((CAST({column} AS DECIMAL(38, 0)) - {low}) div {width} AS INT)")
            counts = rows.where(F.col(column).between(low, high)).groupBy(place.alias("place")).count().orderBy("place").collect()  # at most BUCKETS rows
            for place, count in counts:
                if below + count >= n:
                    low, high = low + place * width, min(high, low + (place + 1) * width - 1)
                    break
                below += count
        return low, below

    if n <= 0:
        return None
    at, below = bound(sessions, time, n)
    tied = sessions.where(F.col(time) == at)
    last, _ = bound(tied, session, n - below)
    return (F.col(time) < at) | ((F.col(time) == at) & (F.col(session) <= last))


class SessionTable:
    def __init__(self, spark: SparkSession, path: str, cap: int, ttl: int | None = None):
        self.spark, self.path, self.cap, self.ttl = spark, path, cap, ttl

    def version(self, number: int) -> DataFrame:
        """(session, events, last_seen, version) after micro-batch `number`; before the first there is none."""
        if number < 0:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/version={number}")

    def advance(self, events: DataFrame, number: int) -> None:
        """For foreachBatch: events (session, at) of micro-batch `number`."""
        now = events.where("session IS NOT NULL AND at IS NOT NULL").groupBy("session").agg(F.count("*").alias("n"), F.max("at").alias("at"))
        both = self.version(number - 1).join(now, "session", "full")
        merged = both.select("session", (F.coalesce("events", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("events"), F.greatest("last_seen", "at").alias("last_seen"), F.lit(number).cast("long").alias("version"))
        draft = f"{self.path}/draft={number}"
        merged.write.mode("overwrite").parquet(draft)
        open_sessions = self.spark.read.schema(SCHEMA).parquet(draft)
        if self.ttl is not None:
            latest = open_sessions.agg(F.max("last_seen")).first()[0]
            if latest is not None:
                open_sessions = open_sessions.where(F.lit(latest) - F.col("last_seen") <= self.ttl)
        gone = oldest(open_sessions, open_sessions.count() - self.cap)
        kept = open_sessions if gone is None else open_sessions.where(~gone)
        kept.write.mode("overwrite").parquet(f"{self.path}/version={number}")
