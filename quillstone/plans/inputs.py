"""Inputs of the registered queries: the given tables in the shapes that the operators read, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import patterns as P

#: Sentences that carry the cues the rules look for; the generated texts have none, so each message gets one of them.
SENTENCES = (
    "I am 34 years old and living in Denver.",
    "My name is Alice Smith, mail alice@example.com or call 555-123-4567.",
    "I work as a software engineer at a startup, my boss is kind.",
    "She graduated from Stanford with a master's degree in law.",
    "The weather is not great today.",
    "In my 20s I moved to Seattle, near the space needle.",
    "Visit https://example.org/page from 10.0.0.1 now.",
    "My boss at the hospital said my dissertation advisor is retired.",
    "Never mind, no reply needed.",
    "I'm a nurse on call, grading papers on campus.",
    "We met on Jan 5, 2021 in Boston, MA at Google.",
    "As a college student I commute to San Francisco, CA.",
)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than there are; larger inputs are not shuffled. For queries
    that take much time for a row."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Rows of a task where each row takes milliseconds.
ROWS_OF_A_TASK = 4000


def dealt(df: DataFrame, rows: int = ROWS_OF_A_TASK) -> DataFrame:
    """df, of files, dealt evenly over tasks of about `rows` rows, at least one for each core. The number of partitions does
    not tell how rows lie in them: all splits of a file but one are empty if it has one row group. Counting reads footers."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)))


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"list_extract([{', '.join(map(quoted, values))}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, other): every message with one sentence more, and with the next sentence as well."""
    c = dealt(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    at = F.col("conv_id") * 7 + F.col("turn")
    base = F.substring(F.coalesce("text", F.lit("")), 1, 1 << 30)
    return c.select("conv_id", "turn", "role", F.concat(base, F.lit(" "), pick(SENTENCES, at)).alias("text"), F.concat(base, F.lit(" "), pick(SENTENCES, at + 1)).alias("other"))


MESSAGES = f"""msg AS (SELECT conv_id, turn, role, coalesce(text, '') || ' ' || {sql_pick(SENTENCES, 'conv_id * 7 + turn')} AS text,
                coalesce(text, '') || ' ' || {sql_pick(SENTENCES, 'conv_id * 7 + turn + 1')} AS other FROM conversations)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text, other): every message with one sentence more, and with another one instead."""
    c = dealt(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    at = F.col("conv_id") * 7 + F.col("turn")
    base = F.coalesce("text", F.lit(""))
    return c.select("conv_id", "turn", F.concat(pick(SENTENCES, at), F.lit(" "), base).alias("text"), F.concat(pick(SENTENCES, at + 5), F.lit(" "), base).alias("other"))


SHORT = f"""sen AS (SELECT conv_id, turn, {sql_pick(SENTENCES, 'conv_id * 7 + turn')} || ' ' || coalesce(text, '') AS text,
                {sql_pick(SENTENCES, 'conv_id * 7 + turn + 5')} || ' ' || coalesce(text, '') AS other FROM conversations)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, attribute, p, y): a probability and a binary label for each order."""
    o = read(spark, sf_dir, "orders")
    p = (F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(1001)) / 1000.0).alias("p")
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), pick(P.ATTRIBUTES, F.col("o_orderkey")).alias("attribute"), p)
    return o.select("id", "attribute", "p", (F.pmod(F.col("id") * 31 + F.col("c"), F.lit(1000)) < F.col("p") * 600 + 200).cast("int").alias("y"))


SCORED = f"""scored AS (SELECT id, attribute, p, CASE WHEN (id * 31 + c) % 1000 < p * 600 + 200 THEN 1 ELSE 0 END AS y FROM (
             SELECT o_orderkey AS id, o_custkey AS c, {sql_pick(P.ATTRIBUTES, 'o_orderkey')} AS attribute,
                    (CAST(round(o_totalprice * 100) AS BIGINT) % 1001) / 1000.0::DOUBLE AS p FROM orders))"""

METHODS = ("raw", "redacted", "rewritten")
FREE_TEXT = {
    "age": ("41", "mid thirties 35", "", "67", "unknown", "19 or 20"),
    "education": ("PhD in Law", "Masters in Business", "Bachelor of Arts", "High School", "", "welding course"),
    "occupation": ("student nurse", "software developer", "hospital doctor", "bank manager", "waiter", "", "poet"),
    "location": ("Bangkok, Thailand", "London, UK", "Toronto, Canada", "Boston, Massachusetts", "Austin, Texas", "", "Lima, Peru", "Denver, Colorado"),
}


def guesses(spark: SparkSession, sf_dir: str, deal: int = 0) -> DataFrame:
    """(id, method, attribute, truth, guess): free-text truths, and guesses that are right, wrong or absent. With deal, orders
    are dealt over tasks of about that many first."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("priority"))
    o = dealt(o, deal) if deal else o
    rows = o.withColumn("attribute", F.explode(F.array(*map(F.lit, P.ATTRIBUTES)))).withColumn("method", pick(METHODS, F.col("id")))
    truth, guess = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in P.ATTRIBUTES:
        truth = F.when(F.col("attribute") == a, pick(FREE_TEXT[a], F.col("c"))).otherwise(truth)
        moved = pick(P.TAXONOMY[a], F.col("c") + F.col("id") % 3)
        guess = F.when(F.col("attribute") == a, F.when(F.col("id") % 7 == 0, "UNKNOWN").otherwise(moved)).otherwise(guess)
    return rows.select("id", "method", "attribute", truth.alias("truth"), guess.alias("guess"))


def _sql_case(values) -> str:
    return "CASE " + " ".join(f"WHEN attribute = '{a}' THEN {values(a)}" for a in P.ATTRIBUTES) + " END"


GUESSES = f"""guesses AS (SELECT id, {sql_pick(METHODS, 'id')} AS method, attribute, {_sql_case(lambda a: sql_pick(FREE_TEXT[a], 'c'))} AS truth,
              CASE WHEN id % 7 = 0 THEN 'UNKNOWN' ELSE {_sql_case(lambda a: sql_pick(P.TAXONOMY[a], 'c + id % 3'))} END AS guess
              FROM (SELECT o_orderkey AS id, o_custkey AS c, unnest([{', '.join(map(quoted, P.ATTRIBUTES))}]) AS attribute FROM orders))"""
