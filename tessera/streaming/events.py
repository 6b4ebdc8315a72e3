"""Streams over events: repeated keys inside a time to live, last states, counters, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def read_events(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def first_in_ttl(events: DataFrame, keys: list[str], ttl: str = "10 minutes", time: str = "ts") -> DataFrame:
    """The first event of each key, later ones left out until the watermark passes it by `ttl`."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, ttl).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


def last_states(events: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The latest value of each key so far: a stateful maximum, updated as events come in any order."""
    return events.groupBy(*keys).agg(F.max(F.struct(time, value)).alias("m")).select(*keys, f"m.{time}", f"m.{value}")


def run_available(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """All that is there now, in batches that `batch` stores; a restart goes on behind the last stored batch."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
