"""Kept state: guarded conversations over micro-batches, the capped session table, the vault, running sums."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import patterns as P
from quillstone.operators.running import numbered, running
from quillstone.sources.vault import Vault
from quillstone.streaming import guard, store

NO = guard._CUT.join(["UNKNOWN"] * 4)


def labels(**known):
    return guard._CUT.join(known.get(a, "UNKNOWN") for a in P.ATTRIBUTES)


def stream(spark, tmp_path, batches, **options):
    """Rows of the guard over the batches (each a run on the same checkpoint) and a last event that lets all time pass."""
    guard.keyed_state(spark)
    schema = "conv_id long, turn long, seconds long, kinds string, names string, before string, after string"
    for i, rows in enumerate([*batches, [(-1, 0, 4_000_000_000, "", "", NO, NO)]]):
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("seconds") + 1_000_000)).drop("seconds")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = guard.guarded(source, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema(guard.OUTPUT).parquet(f"{tmp_path}/out").orderBy("conv_id", "turn").collect()
    return {(r["conv_id"], r["turn"]): r for r in out}


def test_guard_takes_late_turns_in_order_and_forgets(spark, tmp_path):
    one = labels(age="25-34")
    person = ("PERSON", "alice smith")
    turns = [
        [(1, 0, 0, "PERSON\x1fEMAIL_ADDRESS", "alice smith\x1fa@b.cc", one, one), (1, 2, 120, "PERSON", "bob jones", one, NO), (2, 0, 10, *person, NO, NO)],
        [(1, 1, 60, "PERSON", "charlie brown", NO, NO)],  # later than turn 2
        [(1, 3, 7200, *person, NO, one), (2, 1, 3610, *person, NO, NO)],  # an idle gap of more, and of just, an hour
    ]
    got = stream(spark, tmp_path, turns, lateness="10 minutes", idle_ms=3_600_000)
    assert sorted(got) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert [got[1, n]["tokens"] for n in range(4)] == ["PERSON_1,EMAIL_1", "PERSON_2", "PERSON_3", "PERSON_1"]
    assert [got[1, n]["turn_number"] for n in range(4)] == [1, 2, 3, 1] and [got[2, n]["turn_number"] for n in range(2)] == [1, 2]
    assert got[2, 1]["tokens"] == "PERSON_1" and got[2, 1]["entities"] == 1
    step = guard._leak(guard._scores(guard.evidence(one)))
    twice = guard._leak(guard._scores(2 * guard.evidence(one)))
    assert (got[1, 0]["leakage_before"], got[1, 0]["leakage"], got[1, 0]["delta"]) == (step, step, step)
    assert (got[1, 1]["leakage"], got[1, 1]["delta"]) == (step, 0.0)
    # A peek that is not served leaves nothing behind.
    assert (got[1, 2]["leakage_before"], got[1, 2]["delta_before"], got[1, 2]["leakage"]) == (twice, pytest.approx(twice - step), step)
    assert (got[1, 3]["leakage_before"], got[1, 3]["leakage"]) == (0.0, step)


def replay(batches, cap, ttl):
    table = {}
    for rows in batches:
        for s, at in rows:
            if s is not None and at is not None:
                n, last = table.get(s, (0, at))
                table[s] = (n + 1, max(last, at))
        if table:
            now = max(t for _, t in table.values())
            table = {s: v for s, v in table.items() if ttl is None or now - v[1] <= ttl}
        for s in sorted(table, key=lambda s: (table[s][1], s))[: max(0, len(table) - cap)]:
            del table[s]
    return sorted((s, *v) for s, v in table.items())


@pytest.mark.parametrize("seed, span, ttl", [(1, 10**15, None), (2, 12, None), (3, 10**6, 400_000)])
def test_capped_sessions_equal_a_replay(spark, tmp_path, seed, span, ttl):
    rng = random.Random(seed)
    batches = [[(rng.randint(-20, 60), rng.randint(0, span)) for _ in range(n)] for n in (30, 80, 5, 120)] + [[(None, 5), (7, None)]]
    table = store.SessionTable(spark, str(tmp_path), cap=25, ttl=ttl)
    for i, rows in enumerate(batches):
        events = spark.createDataFrame(rows, "session long, at long")
        table.advance(events, i)
        if i == 2:
            table.advance(events, i)  # again, as after a failure
        assert sorted(map(tuple, table.version(i).select("session", "events", "last_seen").collect())) == replay(batches[: i + 1], 25, ttl)


def test_vault_over_two_runs(spark, tmp_path):
    rows = [("a", "PER", " Alice ", 1), ("a", "PER", "ALICE", 2), ("a", "per", "Bob", 3), ("a", "phone", "555", 4), ("b", "PER", "Bob", 1), ("a", "PER", "Carol", 9), ("b", "PER", "  ", 2), ("b", "PER", None, 2), (None, "LOC", "Oslo", 1), ("a", "PER", "Dan", 10), ("a", "PER", "bob", 11)]
    make = lambda path: Vault(spark, f"{tmp_path}/{path}", "secret", "salt")
    df = lambda rows: spark.createDataFrame(rows, "session string, kind string, entity string, at int")
    whole, halves = make("whole"), make("halves")
    whole.learn(df(rows))
    halves.learn(df(rows[:5]))
    halves.learn(df(rows[5:]))
    halves.learn(df(rows))  # nothing new
    table = lambda v: sorted((r["session"] or "", r["token"], r["entity"]) for r in v.opened().collect())
    assert table(whole) == table(halves) == [("", "[LOC_1]", "Oslo"), ("a", "[ID_1]", "555"), ("a", "[PER_1]", "Alice"), ("a", "[PER_2]", "Bob"), ("a", "[PER_3]", "Carol"), ("a", "[PER_4]", "Dan"), ("b", "[PER_1]", "Bob")]
    assert [r["token"] for r in halves.tokens(df([("a", "PER", " carol", 0), ("b", "PER", "carol", 0)])).orderBy("session").collect()] == ["[PER_3]", None]
    sealed = [bytes(r["sealed"]) for r in halves.entries().collect()]
    assert not any(name in x for x in sealed for name in (b"Alice", b"Oslo", b"555"))
    texts = spark.createDataFrame([("a", "[PER_1] met [PER_2], [PER_1] left [PER_9]"), ("b", "[PER_1]"), ("c", "[PER_1]"), ("a", None)], "session string, text string")
    assert [r["text"] for r in halves.restored(texts).orderBy("session", F.col("text").desc()).collect()] == ["Alice met Bob, Alice left [PER_9]", None, "Bob", "[PER_1]"]
    halves.forget("a")
    halves.learn(df([("a", "PER", "Eve", 1), ("b", "PER", "Eve", 1)]))
    assert [(r["session"], r["token"]) for r in halves.opened().where("entity = 'Eve'").orderBy("session").collect()] == [("a", "[PER_1]"), ("b", "[PER_2]")]
    assert make("nothing").entries().count() == 0


def test_running_sums_and_numbers(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.randint(0, 50), i, rng.randint(-5, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v int").repartition(8)
    got = {r["id"]: (r["total"], r["n"]) for r in running(df, ["g"], [F.col("o").desc(), F.col("id")], {"total": F.col("v"), "n": F.lit(1)}).collect()}
    want, sums = {}, {}
    for g, o, i, v in sorted(rows, key=lambda r: (-r[1], r[2])):
        t, n = sums.get(g, (0, 0))
        sums[g] = want[i] = (t + v, n + 1)
    assert got == want
    assert numbered(df.limit(0), ["g"], [F.col("id")]).count() == 0
    assert sorted(r["k"] for r in numbered(df.where("g = 'a'"), [], [F.col("id")], "k").collect()) == list(range(1, sum(r[0] == "a" for r in rows) + 1))
