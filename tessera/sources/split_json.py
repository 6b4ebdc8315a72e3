"""JSON files of one object or one list, read by as many tasks as they have blocks.

Spark's text reader cuts a file into records behind every `}` and splits it anywhere between them.
Which of those braces are structure and how deep they stand follows from everything before, so it
is found by scans over numbers alone: the parity of quotes says whether a record begins inside a
string, and running sums of opened and closed braces say how deep. Records up to a close at the
wanted depth are one unit, the text of a map's entry or of a list's element, which is then parsed by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.storage import materialize

_KEY = r'"((?:[^"\\]++|\\.)*+)"\s*:\s*'


def _opened(parts: Column, parity: int) -> Column:
    """Braces opened outside strings, of a record split at its quotes that begins outside (0) or inside (1) a string."""
    outside = F.filter(parts, lambda _, i: i % 2 == parity)
    return F.aggregate(outside, F.lit(0), lambda n, p: n + F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))


def units(spark: SparkSession, path: str, depth: int) -> DataFrame:
    """(file, unit, before, after, text): what stands up to each brace that closes to `depth` or less, in order from 0.

    before, after: the depth at which a unit begins and ends. What follows a file's last brace is no unit.
    """
    read = spark.read.text(path, lineSep="}")
    order = ["file", "start", "row"]
    records = materialize(
        read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), "value")
    )
    # an escape never reaches over a brace, as \} is none
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)
    counts = records.select(*order, (F.size(parts) - 1).cast("long").alias("quotes"), _opened(parts, 0).alias("out"), _opened(parts, 1).alias("inn"))
    sums = scan.running_sum(counts, "file", ["start", "row"], F.col("quotes"), "seen")
    begins_inside = (F.col("seen") - F.col("quotes")) % 2 == 1
    closes = F.col("seen") % 2 == 0
    steps = sums.select(*order, closes.alias("closes"), (F.when(begins_inside, F.col("inn")).otherwise(F.col("out")) - closes.cast("int")).cast("long").alias("step"))
    levels = scan.running_sum(steps, "file", ["start", "row"], F.col("step"), "after")
    # the text behind the last brace counts as one more close, below the ground
    ends = F.col("closes") & F.col("after").between(0, depth)
    marked = levels.select(*order, (F.col("after") - F.col("step")).alias("before"), "after", ends.alias("ends"))
    placed = scan.running_sum(marked, "file", ["start", "row"], F.col("ends").cast("long"), "done")
    unit = (F.col("done") - F.col("ends").cast("long")).alias("unit")
    joined = placed.select(*order, unit, "before", "after", "ends").join(records, order)
    place = F.struct("start", "row")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "row", "value"))), lambda x: x["value"]), "}")
    whole = joined.groupBy("file", "unit").agg(
        F.min_by("before", place).alias("before"), F.max_by("after", place).alias("after"), F.bool_or("ends").alias("ended"), F.concat(text, F.lit("}")).alias("text")
    )
    return whole.where("ended").drop("ended")


def _name(raw: Column) -> Column:
    """A key as it is meant, of a key as it is written."""
    return F.when(raw.contains("\\"), F.from_json(F.concat(F.lit('{"x":"'), raw, F.lit('"}')), "x string")["x"]).otherwise(raw)


def read_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Of files that hold one object of maps: (file, section, id, value) of their entries that are objects, value as JSON, and
    (file, section, value) of maps without such entries, whole, as JSON."""
    found = materialize(units(spark, path, 2))
    opener = rf"(?s)^[\s,{{]*{_KEY}\{{\s*"
    opened = found.withColumn("section", F.when(F.col("before") < 2, F.nullif(F.regexp_extract("text", opener, 1), F.lit(""))))
    named = scan.fill(opened, "file", ["unit"], "section", "_section")
    inner = F.when(F.col("before") < 2, F.regexp_replace("text", opener, "")).otherwise(F.col("text"))
    entry = rf"(?s)^[\s,]*{_KEY}(\{{.*)$"
    entries = named.where("after = 2").select("file", "_section", inner.alias("t"))
    entries = entries.select("file", _name(F.col("_section")).alias("section"), _name(F.regexp_extract("t", entry, 1)).alias("id"), F.regexp_extract("t", entry, 2).alias("value"))
    flat = named.where("after = 1 and before < 2 and section is not null")
    maps = flat.select("file", _name(F.col("section")).alias("section"), F.concat(F.lit("{"), inner).alias("value"))
    return entries, maps


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the objects of files that hold one list of objects, value as JSON, place from 0."""
    found = units(spark, path, 0)
    return found.select("file", F.col("unit").alias("place"), F.regexp_replace("text", r"^[\s,\[]*", "").alias("value"))
