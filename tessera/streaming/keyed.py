"""State for each key of a stream that ends: the latest value, and counts, kept until nothing came for a while.

Events may come in any order and more than once. A key's state is dropped by an event-time timer
once the watermark has passed its latest event by the time to live, so the store holds the keys of that
span alone, however many a stream ever has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

#: The setting under which a session keeps state that has timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


class _UntilQuiet(StatefulProcessor):
    """One value for each key, with the time of the latest event, until the watermark is `ttl_ms` behind that."""

    def __init__(self, keys: list[str], schema: StructType, ttl_ms: int):
        self.keys, self.schema, self.ttl_ms = keys, schema, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", self.schema)

    def again(self, held: tuple | None, frame: pd.DataFrame) -> tuple:
        """The state after a batch's rows; its first field is the latest event's time."""
        raise NotImplementedError

    def _timer(self, at) -> int:
        return _ms(at) + self.ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = held = tuple(self.state.get()) if self.state.exists() else None
        for frame in rows:
            if len(frame):
                held = self.again(held, frame)
        if held is not None and held != before:
            self.state.update(held)
            if before is None or self._timer(before[0]) != self._timer(held[0]):
                if before is not None:
                    self.handle.deleteTimer(self._timer(before[0]))
                self.handle.registerTimer(self._timer(held[0]))
            yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            held = tuple(self.state.get())
            if self._timer(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                yield self._row(key, held, True)

    def _row(self, key, held: tuple, expired: bool) -> pd.DataFrame:
        fields = dict(zip(self.keys, key)) | dict(zip(self.schema.names, held)) | {"expired": expired}
        return pd.DataFrame({k: [v] for k, v in fields.items()})


class LastState(_UntilQuiet):
    """The greatest (time, value...) so far: which of two events comes last doesn't depend on when they arrive."""

    def again(self, held, frame):
        best = frame.sort_values(self.schema.names).iloc[-1]
        new = tuple(_plain(best[c]) for c in self.schema.names)
        return new if held is None or new > held else held


class Counter(_UntilQuiet):
    """The latest event's time and how many events there were."""

    def again(self, held, frame):
        at, n = frame[self.schema.names[0]].max().to_pydatetime(), len(frame)
        return (at, n) if held is None else (max(at, held[0]), held[1] + n)


def _plain(v):
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull()).withWatermark(time, late)


def _run(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: StructType) -> DataFrame:
    spark = events.sparkSession
    if spark.conf.get(*PROVIDER) != PROVIDER[1]:
        raise RuntimeError(f"{PROVIDER[0]} must be {PROVIDER[1]}")
    out = StructType([events.schema[k] for k in keys] + list(schema.fields) + [StructField("expired", BooleanType())])
    return events.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")


def last_states(events: DataFrame, keys: list[str], time: str, values: list[str], late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """(keys, time, values, expired): a key's latest state whenever it changes, and once more, expired, when it is dropped.

    Of events of one time the greatest values win. Rows later than the watermark, `late` behind the latest event, are left out;
    so are rows without a time. Values must not be null.
    """
    schema = StructType([StructField(time, TimestampType()), *[StructField(v, events.schema[v].dataType) for v in values]])
    return _run(_timed(events, time, late), keys, LastState(keys, schema, ttl_ms), schema)


def counts(events: DataFrame, keys: list[str], time: str, identity: list[str], late: str = "10 minutes", ttl_ms: int = 86_400_000) -> DataFrame:
    """(keys, time, n, expired): a key's number of events whenever it changes, and once more, expired, when it is dropped.

    An event that comes again within the watermark, by `identity`, counts once.
    """
    rows = _timed(events, time, late).dropDuplicatesWithinWatermark(identity)
    schema = StructType([StructField(time, TimestampType()), StructField("n", LongType())])
    return _run(rows, keys, Counter(keys, schema, ttl_ms), schema)
