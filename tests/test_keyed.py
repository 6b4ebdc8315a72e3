"""Keyed stream state against the same rows in a batch: shuffled, repeated, late, and expired."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.streaming import events, keyed

START = datetime(2024, 1, 1)
SCHEMA = "user long, ts timestamp, value long, id long"


@pytest.fixture()
def stored(spark, tmp_path):
    """A function that streams lists of rows, one file and batch each, and gives what came out and the path of the state."""
    old = spark.conf.get(*keyed.PROVIDER)
    spark.conf.set(*keyed.PROVIDER)

    def run(batches, plan):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = []
        query = events.run_available(plan(stream), str(tmp_path / "state"), lambda b, n: out.extend(b.collect()))
        query.awaitTermination(300)
        assert query.exception() is None
        return out, str(tmp_path / "state")

    yield run
    spark.conf.set(keyed.PROVIDER[0], old)


def rows_of(rng, users, n, hours):
    return [(rng.randrange(users), START + timedelta(seconds=rng.randrange(3600 * hours)), rng.randrange(100), i) for i in range(n)]


def test_stream_equals_batch(spark, stored):
    rng = random.Random(2)
    rows = rows_of(rng, 9, 120, 5)
    again = rows + rng.sample(rows, 40)
    rng.shuffle(again)
    out, _ = stored([again[i::3] for i in range(3)], lambda s: keyed.last_states(s, ["user"], "ts", ["value"], "8 hours", 10**10))
    got = {}
    for r in out:
        assert not r["expired"]
        got[r["user"]] = (r["ts"], r["value"])
    assert got == {u: max((t, v) for w, t, v, _ in rows if w == u) for u in {r[0] for r in rows}}


def test_repeated_events_count_once(spark, stored):
    rng = random.Random(3)
    rows = rows_of(rng, 5, 80, 3)
    again = rows + rng.sample(rows, 50)
    rng.shuffle(again)
    out, _ = stored([again[i::2] for i in range(2)], lambda s: keyed.counts(s, ["user"], "ts", ["id"], "8 hours", 10**10))
    got = {}
    for r in out:
        got[r["user"]] = max(got.get(r["user"], (START, 0)), (r["ts"], r["n"]))
    assert {u: n for u, (_, n) in got.items()} == {u: sum(r[0] == u for r in rows) for u in {r[0] for r in rows}}


def test_quiet_keys_leave_the_store(spark, stored):
    """Users 0 to 4 are quiet after the first hour, user 9 goes on; a row that is too late changes nothing."""
    old = [(u, START + timedelta(minutes=u), u, u) for u in range(5)]
    go_on = [[(9, START + timedelta(hours=h), h, 100 + h)] for h in (1, 3, 6)]
    late = [(9, START, 77, 200), (9, START + timedelta(hours=7), 7, 201)]
    out, state = stored([old, *go_on, late], lambda s: keyed.last_states(s, ["user"], "ts", ["value"], "10 minutes", 3_600_000))
    assert sorted(r["user"] for r in out if r["expired"] and r["user"] != 9) == [0, 1, 2, 3, 4]
    assert {r["value"] for r in out if r["user"] == 9 and not r["expired"]} == {1, 3, 6, 7}
    held = spark.read.format("statestore").option("stateVarName", "state").load(state)
    assert [r["key"]["user"] for r in held.select("key").collect()] == [9]
