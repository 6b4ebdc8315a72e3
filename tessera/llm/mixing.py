"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule, its relative weight over training time. The
integral of the schedule, scaled to the source's target, is the number of its words used by
any time; inverting it at a document's place in its source's (hashed) order gives the
document's training position. Documents are range-sorted by position.

Places come from a two-level prefix sum: words per (source, hash bucket) are summed first,
so a source with most of the rows is spread over as many tasks as buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position
from .session import cut, text_or_empty

#: Words: maximal runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Relative weight at the start and at the end of training, for each of WEIGHTS: fixed values.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: Rows of one source and bucket that meet in one window, on average; buckets are made for it.
BUCKET_ROWS = 50_000


def invert_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a piecewise linear schedule has used this share of its integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, F.lit(float(knots[-1][0]))
    parts = []
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        need = share * total - before
        slope = (w1 - w0) / (t1 - t0)
        # w0 * x + slope * x^2 / 2 = need, in the form that is stable for small slopes
        step = 2 * need / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))))
        parts.append((before + area, F.lit(t0) + F.greatest(step, F.lit(0.0))))
        before += area
    for bound, value in reversed(parts):
        out = F.when(share * total <= bound, value).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, demand: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source_key, source_size, weight, turn, target) of sizes (source_key, size), null keys last.

    Weights repeat over the sources in code-point order. The demand is shared by weight; a
    target stops at `most` times its source's size and the excess is shared again. Each
    round is one sum over the sources, and every round but the last caps a source.
    """
    per = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = with_position(per, F.col("source_key").asc_nulls_last(), name="place")
    turn = (F.col("place") % len(weights)).cast("int")
    per = cut(
        ranked.select(
            "source_key", "source_size", turn.alias("turn"),
            F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
            (F.col("source_size") * float(most)).alias("cap"),
        )
    )
    rate = 0.0
    while True:
        full = F.col("weight") * rate >= F.col("cap")
        row = per.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        new = (demand * row["size"] - row["capped"]) / row["weight"] if row["weight"] else rate
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return per.withColumn("target", F.least("cap", F.col("weight") * rate)).drop("cap")


def sizes_of(docs: DataFrame, *more: Column) -> DataFrame:
    """id, source, size, tie (the md5 of the text) and any further columns of docs: a null text has no words."""
    text = text_or_empty(docs)
    return docs.select(
        docs["doc_id"].cast("string").alias("id"), F.concat(F.lit("="), docs["source"].cast("string")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(text.cast("binary")).alias("tie"), *more,
    )


def plan_mix(
    rows: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, schedules=SCHEDULES, demand: float = 1.5
) -> DataFrame:
    """rows (id, source, size, tie, ...) with source_size, target, taken and uses.

    uses: an array of (position, words), one entry for each pass of the source that takes the
    document; only the last document of a source's last pass is taken in part. position: the
    time, from 0 to 1, at which the source's integrated schedule has used the words before the
    middle of the use. The order within a source is that of md5 of seed, id and tie, so reruns agree, and
    rows without an id or of one repeated id are spread over the buckets like any others.
    Rows without words are never taken; null sources are one source, the last; equal rows follow each other; no rows give no rows.
    """
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("id", F.lit("null")), "tie").cast("binary"))
    digits = min(8, max(2, math.ceil(math.log(max(1, rows.count() / BUCKET_ROWS), 16))))
    rows = rows.withColumns({"_hash": hashed, "_bucket": F.substring(hashed, 1, digits)})
    per_bucket = cut(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(per_bucket.select(F.col("source").alias("source_key"), "size"), weights, demand)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_bucket.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(targets, per_bucket["source"].eqNullSafe(targets["source_key"]))
        .select(F.col("source").alias("_k"), F.col("_bucket").alias("_b"), "_before", F.col("turn").alias("_turn"), "source_size", "target")
    )
    running = (
        Window.partitionBy("source", "_bucket").orderBy("_hash", F.col("id").asc_nulls_first(), "size", "tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = rows.withColumn("_within", F.sum("size").over(running)).join(
        offsets, F.col("source").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))
    )
    begin = F.col("_before") + F.col("_within") - F.col("size")

    def use(k: int) -> Column:
        start = begin + F.lit(k) * F.col("source_size")
        words = F.least(F.greatest(F.floor(F.round("target", 6)) - start, F.lit(0)), F.col("size"))
        share = (start + words / 2) / F.greatest(F.col("target"), F.lit(1.0))
        position = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            position = F.when(F.col("_turn") == turn, invert_schedule(share, knots)).otherwise(position)
        return F.struct(position.alias("position"), words.alias("words"))

    uses = F.filter(F.array(use(0), use(1)), lambda x: x["words"] > 0)
    return (
        placed.withColumn("uses", uses)
        .withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
        .drop("_hash", "_bucket", "_within", "_k", "_b", "_before", "_turn")
    )


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position and second_position, sorted by the first position.

    Sizes are taken from the texts once and kept; texts are not shuffled. Null, empty and repeated
    rows are as plan_mix says; other columns are ignored.
    """
    sizes = cut(sizes_of(docs, docs["doc_id"].cast("long").alias("doc_id")))
    return plan_mix(sizes, **options).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.get("uses", F.lit(0))["position"].alias("first_position"), F.get("uses", F.lit(1))["position"].alias("second_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, one row for each use, in the order of training.

    Columns are those of docs, whatever their names. A use of part of a document keeps its first
    words, with their spacing; a column n_chars then follows the text. Null and empty texts have no
    words and are not in the mix; repeated rows are mixed as rows of their own; a null source is a
    source, a null doc_id an id; an empty table gives no rows.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    plan = plan_mix(sizes_of(docs, row), **options).select("id", "row", "size", F.explode("uses").alias("use"))
    part, text = F.col("use.words") < F.col("size"), F.col("row.text")
    # pieces of one word with the white space before it; a repeated group would recurse in the regex engine
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    beginning = F.array_join(F.slice(pieces, F.lit(1), F.col("use.words").cast("int")), "")
    made = {c: F.col("row")[c] for c in docs.columns}
    made["text"] = F.when(part, beginning).otherwise(text)
    if "n_chars" in made:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(part, F.length(made["text"]).cast(kind)).otherwise(made["n_chars"])
    return plan.orderBy("use.position", "id", "size").select(*[v.alias(k) for k, v in made.items()])
