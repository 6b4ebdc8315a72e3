"""Calls of a model from tasks: a few at a time, each with a deadline, and again only for those that failed."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

Model = Callable[[str], str]
#: Rows that one task asks about. Stored rows are no measure of calls: a file of very many equal prompts is tiny.
CALLS = 512


def answered(prompts: Sequence[str], model: Model, at_once: int, deadline: float) -> list[tuple[str | None, str | None]]:
    """(reply, reason why there is none) for each prompt. A call that is past its deadline is left to itself and takes no place any more."""
    out: list = [(None, None)] * len(prompts)
    running: dict[int, tuple[threading.Thread, float, list]] = {}
    following = iter(range(len(prompts)))

    def call(i: int, box: list) -> None:
        try:
            box.append((model(prompts[i]), None))
        except Exception as e:
            box.append((None, f"{type(e).__name__}: {e}"[:200]))

    more = True
    while more or running:
        while more and len(running) < at_once:
            i = next(following, None)
            more = i is not None
            if more:
                box: list = []
                thread = threading.Thread(target=call, args=(i, box), daemon=True)
                running[i] = (thread, time.monotonic(), box)
                thread.start()
        for i, (thread, begun, box) in list(running.items()):
            left = begun + deadline - time.monotonic()
            thread.join(max(0.0, min(left, 0.01)))
            if box:
                out[i] = box[0]
            elif left <= 0:
                out[i] = (None, "deadline")
            elif thread.is_alive():
                continue
            del running[i]
    return out


def ask(rows: DataFrame, key: str, prompt: Column, model: Model, at_once: int = 4, deadline: float = 180.0) -> DataFrame:
    """(key, reply, reason): the model's reply to each row's prompt, or why there is none.

    A task has at most `at_once` calls under way, and none is waited for longer than `deadline` seconds. A call
    that fails or is late is a row with a reason, not a failed job. Replies are stored before this returns, so a later plan does not call again.
    Rows are counted and dealt out, CALLS to a task.
    """
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = answered(f["_prompt"].tolist(), model, at_once, deadline)
            yield pd.DataFrame({key: f[key], "reply": pd.Series([r for r, _ in told], dtype="object", index=f.index), "reason": pd.Series([w for _, w in told], dtype="object", index=f.index)})

    parts = max(1, -(-rows.count() // CALLS))
    some = rows.select(key, F.coalesce(prompt, F.lit("")).alias("_prompt")).repartition(parts, key)
    return materialize(some.mapInPandas(run, f"{key} {kind}, reply string, reason string"))


def ask_in_stages(
    rows: DataFrame, key: str, stages: Sequence[tuple[Column, Model]], accepted: Callable[[DataFrame], DataFrame], at_once: int = 4, deadline: float = 180.0,
    dress: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """(key, stage, reply, reason) of each stage that asked: a stage's prompt goes to the rows of which no stage before has an accepted reply.

    stages: prompt and model of each. accepted: of (key, reply) the keys whose reply will do, as (key). The rows still open are found by an
    anti-join with them, so what is sound is never asked again. Keys must be unique. dress: adds to rows what prompts need beside
    them, so that what is long is not kept from stage to stage.
    """
    open_, out = rows, None
    for i, (prompt, model) in enumerate(stages):
        told = ask(dress(open_), key, prompt, model, at_once, deadline).withColumn("stage", F.lit(i))
        told = told.select(key, "stage", "reply", "reason")
        out = told if out is None else out.unionAll(told)
        good = accepted(told.where("reply is not null").select(key, "reply")).select(key).distinct().hint("merge")
        open_ = materialize(open_.join(good, key, "left_anti"))
        if open_.isEmpty():
            break
    return out
