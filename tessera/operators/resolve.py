"""Resolution of names and keys to stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def resolve_pairs(references: DataFrame, records: DataFrame, keys: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """references with the id of the record that has both keys (of several the least), and those that no record has."""
    one = records.groupBy(*keys).agg(F.min("id").alias("id"))
    matched = references.join(one, list(keys))
    return matched, references.join(one, list(keys), "left_anti")


def fragments(text: str, size: int) -> Column:
    """One row for each distinct run of `size` characters of a column; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    runs = F.transform(starts, lambda i: F.substr(F.col(text), i, F.lit(size)))
    return F.explode(F.when(F.length(text) >= size, F.array_distinct(runs)))


def substring_pairs(short: DataFrame, inner: str, long: DataFrame, outer: str, size: int) -> DataFrame:
    """short joined with long wherever the text `inner` stands in the text `outer`; texts shorter than `size` meet nothing.

    A text that stands in another has all its fragments there. So it asks for one of them alone, the rarest among
    the other side's, and a fragment that very many texts share is a key only for texts that have no other.
    """
    held = long.select(fragments(outer, size).alias("_f"), F.col(outer).alias("_t")).distinct()
    rarity = held.groupBy("_f").agg(F.count("*").alias("_n"))
    texts = short.select(inner).distinct()
    keys = texts.select(inner, fragments(inner, size).alias("_f")).join(rarity, "_f", "left")
    keys = keys.groupBy(inner).agg(F.min_by("_f", F.struct(F.coalesce("_n", F.lit(0)), "_f")).alias("_f"))
    met = keys.join(held, "_f").where(F.contains("_t", inner)).select(inner, F.col("_t").alias(outer))
    return short.join(met, inner).join(long, outer)


def resolve_names(names: DataFrame, forms: DataFrame, least: int = 8) -> DataFrame:
    """(id, other, step, candidates): whom each name means, in three passes.

    names: (id, short, full); forms: (other, form, name): each person's forms of the name, and the full name.
    exact: a form that equals the short or full name. If that is ambiguous, filtered: candidates whose full
    name holds the full name asked for or is held by it, or whose first three words are its own. If nothing
    was found, substring: a form of one person alone that holds the name or is held by it; both longer than
    `least` characters. other is null where several candidates are left, or none.
    """
    asked = names.select("id", F.explode(F.array_distinct(F.array("short", "full"))).alias("form")).where("form <> ''")
    exact = asked.join(forms, "form").select("id", "other").distinct()
    count = Window.partitionBy("id")
    exact = materialize(exact.withColumn("n", F.count("*").over(count)))
    single = exact.where("n = 1").select("id", "other", F.lit("exact").alias("step"), F.lit(1).cast("bigint").alias("candidates"))
    full = forms.select("other", "name").distinct()
    open_ = exact.where("n > 1").select("id", "other").join(names.select("id", "full"), "id").join(full, "other")
    first = lambda c: F.array_join(F.slice(F.split(c, " "), 1, 3), " ")
    three = (F.size(F.split("full", " ")) >= 3) & (first("full") == first("name"))
    fits = (F.length("full") > 10) & (F.contains("full", "name") | F.contains("name", "full") | three)
    marked = open_.withColumns({"fits": fits, "some": F.max(fits).over(count)}).where("fits or not some")
    narrowed = marked.groupBy("id").agg(F.count_distinct("other").alias("candidates"), F.min("other").alias("other"))
    filtered = narrowed.select("id", F.when(F.col("candidates") == 1, F.col("other")).alias("other"), F.lit("filtered").alias("step"), "candidates")
    # the last pass: what is left meets the unambiguous forms by fragments of the shorter of both
    own = forms.groupBy("form").agg(F.count_distinct("other").alias("n"), F.min("other").alias("other")).where((F.col("n") == 1) & (F.length("form") > least))
    rest = asked.join(exact.select("id").distinct(), "id", "left_anti").where(F.length("form") >= least)
    asked_for, listed = rest.select("id", F.col("form").alias("asked")), own.select("other", "form")
    hits = substring_pairs(asked_for, "asked", listed, "form", least).select("id", "other")
    hits = materialize(hits.unionAll(substring_pairs(listed, "form", asked_for, "asked", least).select("id", "other")).distinct())
    found = hits.groupBy("id").agg(F.count("*").alias("candidates"), F.min("other").alias("other"))
    partial = found.select("id", F.when(F.col("candidates") == 1, F.col("other")).alias("other"), F.lit("substring").alias("step"), "candidates")
    done = single.unionByName(filtered).unionByName(partial)
    none = names.join(done.select("id"), "id", "left_anti").select("id", F.lit(None).cast("bigint").alias("other"), F.lit("none").alias("step"), F.lit(0).cast("bigint").alias("candidates"))
    return done.unionByName(none)
