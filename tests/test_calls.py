"""Calls of a model with deadlines, and second calls for failures alone."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import calls, rag


def test_slow_failing_and_sound_calls(spark):
    def model(prompt):
        n = int(prompt)
        if n % 4 == 1:
            time.sleep(60)
        if n % 4 == 2:
            raise ValueError("bad prompt")
        time.sleep(0.3)
        return f"reply {n}"

    rows = spark.range(16, numPartitions=2)
    began = time.monotonic()
    got = {r["id"]: (r["reply"], r["reason"]) for r in calls.ask(rows, "id", F.col("id").cast("string"), model, at_once=4, deadline=1.5).collect()}
    assert time.monotonic() - began < 30  # four of eight calls of a task are slow or late; one by one they would take four minutes
    want = {0: "reply", 1: "deadline", 2: "ValueError: bad prompt", 3: "reply"}
    assert got == {n: (f"reply {n}", None) if n % 4 in (0, 3) else (None, want[n % 4]) for n in range(16)}


def test_calls_under_way_are_bounded():
    import threading

    now, most, lock = [0], [0], threading.Lock()

    def model(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return prompt

    assert calls.answered([str(i) for i in range(40)], model, 3, 10.0) == [(str(i), None) for i in range(40)]
    assert most[0] == 3 and calls.answered([], model, 3, 1.0) == []


def test_only_failures_are_asked_again(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def model(stage):
        def call(prompt):
            (log / f"{stage}-{prompt}-{time.monotonic_ns()}").touch()
            if stage == 0 and int(prompt) % 3 == 0:
                raise RuntimeError("down")
            return "no use" if stage == 0 and int(prompt) % 3 == 1 else f"good {stage}"

        return call

    accepted = lambda told: told.where(F.col("reply").startswith("good"))
    prompt = F.col("id").cast("string")
    out = calls.ask_in_stages(spark.range(9), "id", [(prompt, model(0)), (prompt, model(1)), (prompt, model(2))], accepted, deadline=20.0)
    rows = sorted(map(tuple, out.collect()))
    out.count()  # what is stored is not asked for again
    asked = sorted(tuple(map(int, p.name.split("-")[:2])) for p in log.iterdir())
    assert asked == [(0, i) for i in range(9)] + [(1, i) for i in range(9) if i % 3 != 2]
    assert [(i, s, r) for i, s, r, _ in rows] == sorted(
        [(i, 0, [None, "no use", "good 0"][i % 3]) for i in range(9)] + [(i, 1, "good 1") for i in range(9) if i % 3 != 2], key=lambda x: x[:2]
    )


@pytest.mark.parametrize("down", [False, True])
def test_navigation_falls_back(spark, down):
    questions = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, None, "n")], "question long, book string, text string")
    chapters = spark.createDataFrame([("a", 10 * i, i, f"t{i}") for i in range(5)] + [("b", 7, 0, "only")], "book string, line long, place int, title string")

    def model(prompt):
        if down:
            raise RuntimeError
        if "Question: y" in prompt:
            return "[999]" if prompt.startswith("Question") else '[{"line": 40}, 20]'
        return '"30, 10"' if "Question: x" in prompt else "nothing"

    chosen, told = rag.navigate(questions, chapters, model, deadline=20.0)
    got = {}
    for r in sorted(chosen.collect(), key=lambda r: r["place"]):
        got.setdefault(r["question"], []).append(r["chapter"])
    first = {1: [0, 10], 2: [0, 10], 3: [7]}
    assert got == (first if down else {1: [30, 10], 2: [40, 20], 3: [7]})
    stages = sorted((r["question"], r["stage"]) for r in told.collect())
    assert stages == [(q, s) for q in (1, 2, 3, 4) for s in (0, 1) if down or q != 1 or s == 0]


def test_calls_are_dealt_by_their_number(spark, monkeypatch):
    """Equal prompts make one tiny file, of which one task would ask everything."""
    monkeypatch.setattr(calls, "CALLS", 8)
    rows = spark.range(64).coalesce(1)
    told = calls.ask(rows, "id", F.lit("the same"), lambda _: str(__import__("pyspark").TaskContext.get().partitionId()), deadline=20.0)
    got = [(r["id"], r["reply"]) for r in told.collect()]
    assert sorted(i for i, _ in got) == list(range(64)) and len({p for _, p in got}) > 4


def test_navigation_broadcasts_no_row_of_each_question(spark, monkeypatch):
    """Stored replies that are alike are small as files alone: what has a row for each question is never sent to the driver."""
    questions = spark.range(200).select(F.col("id").alias("question"), F.lit("a").alias("book"), F.col("id").cast("string").alias("text"))
    chapters = spark.createDataFrame([("a", i, i, f"t{i}") for i in range(50)], "book string, line long, place int, title string")
    chosen, told = rag.navigate(questions, chapters, lambda prompt: str(list(range(40))), deadline=20.0)
    assert {tuple(r) for r in chosen.where("question < 2").collect()} == {(q, i, i) for q in range(2) for i in range(3)}
    assert told.count() == 200
    plan = chosen._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "question" in x]
    assert not joins


def test_counted_calls_broadcast_no_row_of_each_question(spark):
    from tessera.plans import registry

    plan = registry.QUERIES["navigation_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "question" in x]
