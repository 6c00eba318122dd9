"""A persistent vault of pseudonyms: the same entity of a session keeps its token from run to run.

The vault is a table in versions: (session, kind, number, digest, sealed). The digest, salted SHA-256 of the trimmed
lower-case entity, finds an entity; the entity itself is sealed by AES-GCM under a key derived from secret and salt. New
entities are numbered on from what their session and kind have, in the order of their first appearance; numbers come from
running counts, so a session that holds most entities is no single task. A version is written whole, and a reader takes
the last one that is complete: a run that fails leaves the vault as it was.

Defined cases: blank and null entities are none; kinds that are not KINDS are ID; a null session is the session of null;
entities that differ only in case or in white space around them are one, sealed as first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.running import numbered

KINDS = ("PER", "LOC", "ORG", "DATE", "ID")
SCHEMA = "session string, kind string, number long, digest string, sealed binary"


class Vault:
    def __init__(self, spark: SparkSession, path: str, secret: str, salt: str):
        self.spark, self.path, self.salt = spark, path, salt
        self.key = F.unhex(F.sha2(F.lit(f"{salt}:{secret}"), 256))

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [str(s.getPath().getName()) for s in fs.listStatus(path)]
        return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def entries(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], SCHEMA)

    def _write(self, entries: DataFrame) -> None:
        entries.select(*(c.split()[0] for c in SCHEMA.split(", "))).write.parquet(f"{self.path}/v{max([0, *self._versions()]) + 1}")

    def digest(self, entity: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.salt), F.lower(F.trim(entity))), 256)

    @staticmethod
    def kind(kind: Column) -> Column:
        clean = F.upper(F.trim(kind))
        return F.when(clean.isin(*KINDS), clean).otherwise("ID")

    @staticmethod
    def token() -> Column:
        return F.concat(F.lit("["), F.col("kind"), F.lit("_"), F.col("number"), F.lit("]"))

    def learn(self, entities: DataFrame, at: str = "at") -> None:
        """Give tokens to what is new in entities (session, kind, entity, at); `at` is any ordered column."""
        clean = entities.where(F.trim("entity") != "").select(F.col("session").cast("string").alias("session"), self.kind(F.col("kind")).alias("kind"), self.digest(F.col("entity")).alias("digest"), F.trim("entity").alias("entity"), F.col(at).alias("at"))
        first = clean.groupBy("session", "kind", "digest").agg(F.min(F.struct("at", "entity")).alias("first"))
        known = self.entries()
        same = [first["session"].eqNullSafe(known["session"]), first["kind"] == known["kind"], first["digest"] == known["digest"]]
        new = first.join(known, same, "left_anti")
        ranked = numbered(new.select("session", "kind", "digest", "first"), ["session", "kind"], [F.col("first.at"), F.col("digest")], "rank")
        most = known.groupBy(F.col("session").alias("s"), F.col("kind").alias("k")).agg(F.max("number").alias("most"))
        joined = ranked.join(most, [ranked["session"].eqNullSafe(most["s"]), ranked["kind"] == most["k"]], "left")
        sealed = F.aes_encrypt(F.encode("first.entity", "UTF-8"), self.key, F.lit("GCM"))
        self._write(known.unionByName(joined.select("session", "kind", (F.col("rank") + F.coalesce("most", F.lit(0))).alias("number"), "digest", sealed.alias("sealed"))))

    def tokens(self, entities: DataFrame) -> DataFrame:
        """entities (session, kind, entity, ...) with token; null for what was never learned."""
        known = self.entries().select(F.col("session").alias("__s"), F.col("kind").alias("__k"), F.col("digest").alias("__d"), self.token().alias("token"))
        same = [F.col("session").cast("string").eqNullSafe(F.col("__s")), self.kind(F.col("kind")) == F.col("__k"), self.digest(F.col("entity")) == F.col("__d")]
        return entities.join(known, same, "left").drop("__s", "__k", "__d")

    def opened(self) -> DataFrame:
        """(session, token, entity): what the tokens stand for."""
        return self.entries().select("session", self.token().alias("token"), F.decode(F.aes_decrypt("sealed", self.key, F.lit("GCM")), "UTF-8").alias("entity"))

    def restored(self, texts: DataFrame, session: str = "session", text: str = "text") -> DataFrame:
        """texts with the tokens of the text's session put back, whatever their number; tokens that stand for nothing stay."""
        parts = texts.withColumn("__id", F.monotonically_increasing_id())
        tokens = parts.select("__id", F.col(session).cast("string").alias("__s"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(?:PER|LOC|ORG|DATE|ID)_\d+\]"), F.lit(0)))).alias("token"))
        opened = self.opened()
        found = tokens.join(opened, [tokens["__s"].eqNullSafe(opened["session"]), tokens["token"] == opened["token"]]).groupBy("__id").agg(F.collect_list(F.struct(tokens["token"].alias("token"), "entity")).alias("__puts"))
        puts = F.coalesce("__puts", F.expr("cast(array() as array<struct<token:string,entity:string>>)"))
        return parts.join(found, "__id", "left").withColumn(text, F.aggregate(puts, F.col(text), lambda t, p: F.replace(t, p["token"], p["entity"]))).drop("__id", "__puts")

    def forget(self, session: str) -> None:
        """A session's entities go; numbers of other sessions stay as they are."""
        self._write(self.entries().where(~F.col("session").eqNullSafe(F.lit(session))))
