"""Writers: JSON lines with a split, one folder for each group, upserts by partition, resumable loads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_split_jsonl(rows: DataFrame, path: str, key: str, seed: int = 42, held: int = 10) -> None:
    """One folder each for train and valid, rows in a shuffled order; both depend on seed and key alone."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(held))
    split = rows.withColumns({"split": F.when(bucket == 0, "valid").otherwise("train"), "_o": F.xxhash64(F.lit(seed + 1), key)})
    ordered = split.repartitionByRange("split", "_o").sortWithinPartitions("split", "_o", key)
    ordered.drop("_o").write.mode("overwrite").partitionBy("split").json(path)


def write_groups(rows: DataFrame, path: str, group: str, numbers: tuple[str, ...] = ()) -> None:
    """One folder of JSON for each group; columns that should hold numbers are null where they don't, and rows without a group are left out."""
    guarded = rows.withColumns({c: F.col(c).try_cast("bigint") for c in numbers}).where(F.col(group).isNotNull())
    guarded.write.mode("overwrite").partitionBy(group).json(path)


def load_once(spark, path: str, rows: DataFrame) -> bool:
    """Writes rows unless path has some already; says whether it did."""
    try:
        if not spark.read.parquet(path).isEmpty():
            return False
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(path)
    return True


def create(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key path does not have yet, each key once."""
    one = rows.dropDuplicates([key])
    try:
        one = one.join(rows.sparkSession.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    one.write.mode("append").parquet(path)


def relate(edges: DataFrame, source: DataFrame, target: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Appends edges (src, dst, ...) whose ends both exist, and returns those that dangle."""
    sound = edges.join(source.select(F.col(key).alias("src")).distinct(), "src", "left_semi").join(target.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi")
    sound.select(*edges.columns).write.mode("append").parquet(path)
    return edges.join(sound.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def delete_where(path: str, to: str, spark, condition: Column | None = None) -> None:
    """Writes to `to` what remains of path without the rows where the condition is true; without one nothing remains but the schema."""
    rows = spark.read.parquet(path)
    keep = F.lit(False) if condition is None else ~F.coalesce(condition, F.lit(False))
    rows.where(keep).write.mode("overwrite").parquet(to)


def write_batches(rows: DataFrame, path: str, key: str, batch: int = 200) -> int:
    """Writes rows in batches of about `batch`, each a folder that is there whole or not at all; batches that are there are left alone.

    Which batch a row is in depends on its key alone, so a repeated run goes on where the last one stopped. Returns how many it wrote.
    """
    spark, n = rows.sparkSession, max(1, -(-rows.count() // batch))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wrote = 0
    for i in range(n):
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={i}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).write.mode("overwrite").parquet(f"{path}/batch={i}")
            wrote += 1
    return wrote


def notes_json(notes: DataFrame, group: str, order: str) -> DataFrame:
    """(group, json): a group's notes in order as one JSON list."""
    row = F.struct(*[c for c in notes.columns if c != group])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), row.alias("n")))), lambda s: s["n"])
    return notes.groupBy(group).agg(F.to_json(listed).alias("json"))


def pending(wanted: DataFrame, done: DataFrame, key: str, size: Column | None = None, most: int | None = None) -> DataFrame:
    """What is still to do: keys without a result, and not over the size limit if one is given."""
    rows = wanted.join(done.select(key).distinct(), key, "left_anti")
    return rows if size is None or most is None else rows.where(size <= most)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Copy on write: new rows replace or join the old ones; a null field of a new row leaves the old value."""
    a, b = old.alias("a"), new.alias("b")
    fields = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in new.columns else F.col(f"a.{c}") for c in old.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *fields)


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Only the partitions that rows has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts: the violations of a unique constraint."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def markdown(headings: DataFrame, pages: DataFrame, group: str, order: str) -> DataFrame:
    """(group, markdown): headings (title, level) and page texts in order, a heading one level deeper than given and at most six."""
    mark = F.repeat(F.lit("#"), F.least(F.col("level") + 1, F.lit(6)))
    a = headings.select(group, F.col(order).alias("o"), F.lit(0).alias("k"), F.concat(mark, F.lit(" "), F.col("title")).alias("x"))
    b = pages.select(group, F.col(order).alias("o"), F.lit(1).alias("k"), F.col("text").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "x"))), lambda s: s["x"])
    return a.unionAll(b).groupBy(group).agg(F.array_join(ordered, "\n\n").alias("markdown"))
