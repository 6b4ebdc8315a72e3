"""A table that writes reach whole or not at all: files of tasks, and commits that name them.

Tasks write Parquet files that no commit names yet and report them. Only when all have reported
without a repeated key is one commit file made, exclusively; readers see what commits name. A task that
fails, a repeated key or a rival commit leaves nothing to see, and what tasks wrote is removed.
"""

from __future__ import annotations

import contextlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

COMMITS, DATA = "_commits", "data"
#: Repeated keys that a task reports, at most; it counts them all.
SHOWN = 5


class Conflict(Exception):
    """Another write committed first, or keys that must be unique are not."""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its file, or none without rows; repeats: keys that stood in more than one row."""

    file: str | None
    rows: int
    repeats: int
    shown: tuple[str, ...]


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.key, self.run = options["path"].rstrip("/"), options.get("key"), options["run"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """One file of a task's rows. Rows arrive in the order of their keys, so that repeated keys follow each other."""
        name, system, at = f"{self.run}-{uuid.uuid4().hex}.parquet", *_store(self.path)
        rows, repeats, shown, last, out = 0, 0, [], None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(f"{at}/{DATA}", recursive=True)
                    out = pq.ParquetWriter(f"{at}/{DATA}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
                for k in batch.column(self.key).to_pylist() if self.key else ():
                    if k is not None and k == last:
                        repeats += 1
                        shown = [*shown, str(k)][:SHOWN]
                    last = k
        finally:
            if out is not None:
                out.close()
        return Written(name if rows else None, rows, repeats, tuple(shown))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Lists the files for the commit that follows; fails on repeated keys, before anything can be seen."""
        told = [m for m in messages if m is not None]
        repeats = sum(m.repeats for m in told)
        if repeats:
            shown = [k for m in told for k in m.shown][:SHOWN]
            raise Conflict(f"{repeats} rows repeat a key of {self.key}, such as {', '.join(shown)}")
        system, at = _store(self.path)
        system.create_dir(f"{at}/{DATA}", recursive=True)
        listed = {"files": sorted(m.file for m in told if m.file), "rows": sum(m.rows for m in told)}
        with system.open_output_stream(f"{at}/{DATA}/{self.run}.json") as f:
            f.write(json.dumps(listed).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Nothing to undo: no commit names a file. The caller removes what tasks left."""


class Committed(DataSource):
    """Options: path, run (names this write's files) and key, a column whose values must be unique."""

    @classmethod
    def name(cls) -> str:
        return "tessera_committed"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options)


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[int]:
    at, system = _hadoop(spark, f"{path}/{COMMITS}")
    return sorted(int(s.getPath().getName().removesuffix(".json")) for s in system.listStatus(at)) if system.exists(at) else []


def _text(spark: SparkSession, path: str) -> str:
    at, system = _hadoop(spark, path)
    f = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
    finally:
        f.close()


def _publish(spark: SparkSession, path: str, number: int, text: str) -> None:
    """Makes commit `number`, or fails where one exists."""
    at, system = _hadoop(spark, f"{path}/{COMMITS}/{number}.json")
    try:
        f = system.create(at, False)
    except Exception as e:
        if "already exists" in str(e):
            raise Conflict(f"commit {number} was made by another write") from e
        raise
    f.write(bytearray(text.encode()))
    f.close()


def _sweep(spark: SparkSession, path: str, run: str, everything: bool) -> None:
    """Removes a run's list of files, and its files too if they were not committed."""
    at, system = _hadoop(spark, f"{path}/{DATA}")
    if system.exists(at):
        for s in system.listStatus(at):
            name = s.getPath().getName()
            if name == f"{run}.json" or everything and name.startswith(f"{run}-"):
                system.delete(s.getPath(), False)


def write(rows: DataFrame, path: str, key: str | None = None) -> int:
    """Appends rows in one commit and returns its number, from 0.

    With a key: a repeated value among the rows, or one that the table has already, fails the whole write.
    Repeats among the rows are found by the tasks, to which all rows of a key go, those of the table by a semi-join against the commits there
    are; a commit made meanwhile fails this one, so that nothing slips in between. Null keys are not compared.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    known = commits(spark, path)
    if key is not None:
        if known and not rows.select(key).join(read(spark, path).select(key), key, "left_semi").isEmpty():
            raise Conflict(f"the table has a row with the same {key} already")
        rows = rows.repartition(key).sortWithinPartitions(key)
    spark.dataSource.register(Committed)
    options = {"path": path, "run": run} | ({"key": key} if key else {})
    done = False
    try:
        rows.write.format("tessera_committed").mode("append").options(**options).save()
        number = known[-1] + 1 if known else 0
        _publish(spark, path, number, _text(spark, f"{path}/{DATA}/{run}.json"))
        done = True
        return number
    finally:
        with contextlib.suppress(Exception) if not done else contextlib.nullcontext():
            _sweep(spark, path, run, everything=not done)


def read(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The rows of all commits, or of those up to one."""
    files = [f for n in commits(spark, path) if upto is None or n <= upto for f in json.loads(_text(spark, f"{path}/{COMMITS}/{n}.json"))["files"]]
    if not files:
        raise FileNotFoundError(f"{path} has no committed rows")
    return spark.read.parquet(*[f"{path}/{DATA}/{f}" for f in files])


def count_by_commit(spark: SparkSession, path: str) -> DataFrame:
    """(commit, files, rows) as the commits say."""
    told = [(n, json.loads(_text(spark, f"{path}/{COMMITS}/{n}.json"))) for n in commits(spark, path)]
    return spark.createDataFrame([(n, len(x["files"]), x["rows"]) for n, x in told], "commit long, files long, rows long").orderBy(F.col("commit"))
