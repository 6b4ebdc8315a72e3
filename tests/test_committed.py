"""Writes that are there whole or not at all."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import committed


def left_over(path):
    return sorted(f for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_commits_add_up(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(0, 1000, numPartitions=5).withColumn("name", F.concat(F.lit("n"), "id"))
    assert committed.write(rows, path, "id") == 0
    assert committed.write(rows.withColumn("id", F.col("id") + 1000), path, "id") == 1
    assert committed.write(rows.limit(0), path) == 2
    got = committed.read(spark, path)
    assert got.columns == ["id", "name"] and got.count() == 2000 and got.agg(F.count_distinct("id")).first()[0] == 2000
    assert committed.read(spark, path, upto=0).agg(F.max("id")).first()[0] == 999
    assert [(r["commit"], r["rows"]) for r in committed.count_by_commit(spark, path).collect()] == [(0, 1000), (1, 1000), (2, 0)]


@pytest.mark.parametrize("how", ["raise", "kill"])
def test_a_lost_task_leaves_nothing(spark, tmp_path, how):
    """One task raises, or its Python worker is killed, after others wrote their files."""
    path = str(tmp_path / "t")
    committed.write(spark.range(10), path, "id")
    before = left_over(path)

    def some(frames):
        for f in frames:
            if (f["id"] == 777).any():
                if how == "kill":
                    os.kill(os.getpid(), 9)
                raise RuntimeError("lost")
            yield f

    rows = spark.range(100, 1000, numPartitions=4).mapInPandas(some, "id long")
    with pytest.raises(Exception, match="lost|crashed|exited|Exception"):
        committed.write(rows, path, "id")
    assert left_over(path) == before
    assert committed.read(spark, path).count() == 10
    assert committed.write(spark.range(100, 1000), path, "id") == 1
    assert committed.read(spark, path).count() == 910


def test_keys_are_unique_or_nothing_is_written(spark, tmp_path):
    path = str(tmp_path / "t")
    twice = spark.range(500).unionAll(spark.range(7, 8))
    with pytest.raises(PySparkException, match="1 rows repeat a key of id, such as 7"):
        committed.write(twice, path, "id")
    assert left_over(path) == [] and committed.commits(spark, path) == []
    with pytest.raises(FileNotFoundError):
        committed.read(spark, path)
    committed.write(spark.range(500), path, "id")
    with pytest.raises(committed.Conflict, match="already"):
        committed.write(spark.range(499, 600), path, "id")
    assert committed.write(twice, path) == 1  # nobody asked for unique keys
    nulls = spark.createDataFrame([(None,), (None,), (9999,)], "id long")
    assert committed.write(nulls, path, "id") == 2


def test_a_rival_commit_wins(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    committed.write(spark.range(5), path, "id")
    real = committed._text

    def rival(s, at):
        monkeypatch.setattr(committed, "_text", real)
        committed.write(spark.range(5, 9), path, "id")
        return real(s, at)

    monkeypatch.setattr(committed, "_text", rival)
    with pytest.raises(committed.Conflict, match="commit 1"):
        committed.write(spark.range(8, 20).withColumnRenamed("id", "other"), path)
    assert sorted(r["id"] for r in committed.read(spark, path).collect()) == list(range(9))
    assert len([f for f in left_over(path) if f.endswith(".parquet")]) == len([f for n in committed.count_by_commit(spark, path).collect() for f in range(n["files"])])
