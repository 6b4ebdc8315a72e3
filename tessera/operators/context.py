"""Contexts, prompts and training pairs from query results; models are injected callables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Intents that a structured question can have; anything else is answered from content.
INTENTS = ("narrator_info", "count", "narrator_hadiths", "teachers", "students", "chain", "content")


def ordered_join(order: Column, text: Column, separator: str = "\n") -> Column:
    """An aggregate: texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("x")))), lambda s: s["x"]), separator)


def context_blocks(rows: DataFrame, group: str, order: str, title: str, text: str, cap: int = 1000) -> DataFrame:
    """One context per group: its rows in order as '[n] title' and text, each text cut at `cap` characters."""
    body = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("..."))).otherwise(F.col(text))
    entry = F.format_string("[%d] %s\n%s", F.col(order), F.col(title), body)
    return rows.groupBy(group).agg(ordered_join(F.col(order), entry, "\n\n").alias("context"), F.count("*").alias("entries"))


def parse_intent(reply: Column) -> Column:
    """(intent, name) from a model's JSON reply; unknown intents and empty names mean content."""
    parsed = F.from_json(reply, "intent string, name string")
    name = F.trim(F.coalesce(parsed["name"], F.lit("")))
    known = F.coalesce(parsed["intent"].isin(*INTENTS), F.lit(False)) & (name != "")
    return F.struct(F.when(known, parsed["intent"]).otherwise("content").alias("intent"), F.when(known, name).alias("name"))


def ask(contexts: DataFrame, question: str, model: Callable[[str], str] | None = None) -> DataFrame:
    """contexts with answer; without a model the context itself, so that retrieval can be tested alone."""
    if model is None:
        return contexts.withColumn("answer", F.col("context"))
    import pandas as pd

    def run(frames):
        for f in frames:
            yield f.assign(answer=pd.Series([model(f"{c}\n\n{question}") for c in f["context"]], dtype="object"))

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in contexts.schema)
    return contexts.mapInPandas(run, f"{fields}, answer string")


def training_pairs(rows: DataFrame, key: str, question: Column, answer: Column, seed: int = 42, held: int = 10) -> DataFrame:
    """(key, split, record): chat records as JSON, one in `held` (by a hash of seed and key) for validation."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    record = F.to_json(F.struct(F.array(message("user", question), message("assistant", answer)).alias("messages")))
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 6), 16, 10).cast("bigint")
    return rows.select(key, F.when(bucket % held == 0, "valid").otherwise("train").alias("split"), record.alias("record"))
