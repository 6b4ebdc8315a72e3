"""Which sets share most elements with each set: exact, with elements that very many sets have.

Sets with the same elements are one class. Elements are ordered by rising frequency. Pairs that
share a rare element are listed through it, and their counts bound from below what a class's
best partners share. A class whose frequent elements are fewer than this bound is settled: sets that
share only those can't come first. The others are compared in tiles, whose tasks count common
elements over posting lists and return the best few alone; no pair of them is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .skew import meet, with_counts
from .storage import materialize

#: Sets that an element may have for its pairs to be listed.
LIGHT = 32
#: Classes whose best partners a tile looks for, and those that it looks among.
PROBES, TILE = 65_536, 131_072
#: Tiles up to which there are more of them, of FEW probes each: few classes are dealt to many tasks. Copies of a set grow with PROBES and TILE alone.
TILES, FEW = 64, 16_384
#: Rows in one part of what at_least sorts: equal ids compress so well that bytes of a shuffle tell little of a task's memory.
PART_ROWS = 1 << 18


def _classes(rows: DataFrame, best: int) -> tuple[DataFrame, DataFrame]:
    """(members: id, cid) and (classes: cid, elements, counts, hashes, heads).

    Elements that one set alone has link nothing and are left out. cid rises with a class's least id; heads: its first ids.
    """
    shared = with_counts(rows.select("id", "element").distinct(), "element", "id", "n").where("n >= 2")
    sets = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "element"))).alias("s"))
    sets = materialize(sets.select("id", "s", F.sha2(F.to_json(F.col("s.element")), 256).alias("name")))
    place = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    heads = sets.select("name", "id", place.alias("place")).where(F.col("place") <= best)
    heads = heads.groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("heads"))
    classes = sets.groupBy("name").agg(F.first("s").alias("s")).join(heads, "name")
    classes = classes.select(
        "name", F.col("s.element").alias("elements"), F.col("s.n").alias("counts"), F.transform("s", lambda x: F.xxhash64(x["element"])).alias("hashes"), "heads"
    )
    first = F.get("heads", F.lit(0))
    classes = materialize(classes.repartitionByRange(first).sortWithinPartitions(first).withColumn("cid", F.monotonically_increasing_id()))
    return meet(sets.select("id", "name"), classes.select("name", "cid"), ["name"], "id").select("id", "cid"), classes.drop("name")


def _through_light(classes: DataFrame, light: int, best: int) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, shared) of classes that rare elements settle, and (open: a, bound) of the others.

    bound: what the best-th partner shares with a class by rare elements alone, 0 if there are fewer.
    """
    heavy = F.size(F.filter("counts", lambda n: n > light)).cast("long")
    each = classes.select("cid", F.explode(F.arrays_zip("hashes", "counts")).alias("x")).where(F.col("x.counts") <= light).select("cid", F.col("x.hashes").alias("e"))
    pairs = each.select(F.col("cid").alias("a"), "e").join(each.select(F.col("cid").alias("b"), "e"), "e").where("a <> b")
    pairs = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("shared")))
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))).where(F.col("_r") <= best)
    bounds = ranked.groupBy("a").agg(F.when(F.count("*") >= best, F.min("shared")).otherwise(0).alias("bound"))
    known = classes.select(F.col("cid").alias("a"), heavy.alias("heavy")).join(bounds, "a", "left")
    known = materialize(known.select("a", "heavy", F.coalesce("bound", F.lit(0)).alias("bound")))
    settled = known.where("heavy < bound or heavy = 0")
    few = pairs.join(settled, "a").join(known.select(F.col("a").alias("b"), F.col("heavy").alias("_hb")), "b")
    few = few.where(F.col("shared") + F.least("heavy", "_hb") >= F.col("bound"))
    sets = classes.select("cid", "hashes")
    exact = (
        few.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("_x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("_y")), "b")
        .select("a", "b", F.size(F.array_intersect("_x", "_y")).cast("long").alias("shared"))
    )
    return exact, known.join(settled.select("a"), "a", "left_anti").select("a", "bound")


def _tile(best: int):
    def run(probes: pd.DataFrame, holders: pd.DataFrame) -> pd.DataFrame:
        a_found, best_found = [], []
        if len(probes) and len(holders):
            holders = holders.sort_values("b")
            cid = holders["b"].to_numpy()
            lengths = np.array([len(x) for x in holders["terms"]])
            values, code = np.unique(np.concatenate(holders["terms"].to_list()), return_inverse=True)
            posting = np.repeat(np.arange(len(cid)), lengths)[np.argsort(code, kind="stable")]
            start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(values)))])
            for a, hashes, bound in zip(probes["a"], probes["hashes"], probes["bound"]):
                at = np.searchsorted(values, hashes)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == hashes)]
                if not len(at):
                    continue
                count = np.bincount(np.concatenate([posting[start[i] : start[i + 1]] for i in at]), minlength=len(cid))
                found = np.flatnonzero(count >= max(1, bound))
                found = found[cid[found] != a]
                found = found[np.lexsort((cid[found], -count[found]))[:best]]
                if len(found):
                    a_found.append(a)
                    best_found.append([{"less": -int(n), "b": int(b)} for n, b in zip(count[found], cid[found])])
        return pd.DataFrame({"a": pd.Series(a_found, dtype="int64"), "best": pd.Series(best_found, dtype="object")})

    return run


def tile_sides(probes: int, parts: int, tile: int = TILE) -> int:
    """Into how many parts so many probes are dealt; each takes a copy of every set, so beyond TILES tiles they are as large as PROBES allows."""
    return max(1, -(-probes // min(tile, PROBES)), min(-(-probes // min(tile, FEW)), -(-TILES // parts)))


def _through_tiles(classes: DataFrame, open_: DataFrame, best: int, tile: int) -> DataFrame:
    """(a, b, shared): each open class's best partners. A tile gives one row for a class, so that lists meet and not pairs."""
    parts = max(1, -(-classes.count() // tile))
    sides = tile_sides(open_.count(), parts, tile)
    part = lambda n: F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    probes = classes.join(open_, F.col("cid") == F.col("a")).select("a", "bound", "hashes", part(sides).alias("p"), every(parts).alias("q"))
    holders = classes.select(F.col("cid").alias("b"), F.col("hashes").alias("terms"), part(parts).alias("q"), every(sides).alias("p"))
    lists = probes.groupBy("p", "q").cogroup(holders.groupBy("p", "q")).applyInPandas(_tile(best), "a bigint, best array<struct<less:bigint,b:bigint>>")
    merged = lists.groupBy("a").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, best).alias("best"))
    return merged.select("a", F.explode("best").alias("x")).select("a", "x.b", (-F.col("x.less")).alias("shared"))


def at_least(rows: DataFrame, group: str, key: str, element: str, least: int) -> DataFrame:
    """(group, a, b, shared): pairs a < b of a group's keys that have `least` elements or more in common.

    rows: distinct (group, key, element). Sets that share so many meet in all but the least - 1 most frequent elements of
    either, so each set is listed under those alone; what an element of nearly every set would pair is never made.
    Rows are dealt into parts of about PART_ROWS, so that what a task sorts doesn't grow with the table.
    """
    rows = materialize(rows.select(group, key, element))
    parts = max(1, -(-rows.count() // PART_ROWS))
    rows = rows.repartition(parts, group, element)
    counted = rows.groupBy(group, element).agg(F.count("*").alias("_n")).where("_n > 1")
    ordered = F.array_sort(F.collect_list(F.struct("_n", F.col(element).alias("e"))))
    repeated = rows.join(counted, [group, element]).repartition(parts, group, key)
    sets = repeated.groupBy(group, key).agg(F.transform(ordered, lambda x: x["e"]).alias("_set")).where(F.size("_set") >= least)
    listed = materialize(sets.select(group, F.col(key).alias("k"), "_set", F.explode(F.slice("_set", F.lit(1), F.size("_set") - (least - 1))).alias("e")))
    listed = listed.repartition(max(1, -(-listed.count() // PART_ROWS)), group, "e")
    a, b = listed.select(group, F.col("k").alias("a"), "e", F.col("_set").alias("_x")), listed.select(group, F.col("k").alias("b"), "e", F.col("_set").alias("_y"))
    met = a.join(b, [group, "e"]).where("a < b").withColumn("_common", F.array_intersect("_x", "_y"))
    # a pair is told once, in the first element that it meets in
    first = F.array_position("_x", F.col("e")) == F.array_min(F.transform(F.array_intersect(F.slice("_x", F.lit(1), F.size("_x") - (least - 1)), F.slice("_y", F.lit(1), F.size("_y") - (least - 1))), lambda e: F.array_position(F.col("_x"), e)))
    return met.where((F.size("_common") >= least) & first).select(group, "a", "b", F.size("_common").cast("long").alias("shared"))


def top_overlaps(rows: DataFrame, most: int = 5, light: int = LIGHT, tile: int = TILE) -> DataFrame:
    """(id, other, shared, least, rank): for each id the `most` others with most common elements, then the least ids.

    rows: (id, element); repeated rows count once, ids and elements must not be null; an id may be a struct. least: the least common element.
    Every pair counts, whatever the number of sets that an element is in. Classes that rare
    elements don't settle cost a visit to each tile of `tile` classes: that part grows with the square of
    their number, in counts inside tasks, while rows stay in proportion to classes times tiles.
    """
    best = most + 1  # a class's list holds each of its own members, too
    members, classes = _classes(rows, best)
    settled, open_ = _through_light(classes, light, best)
    pairs = settled.unionAll(_through_tiles(classes, open_, best, tile))
    by_class = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    pairs = pairs.withColumn("_r", F.row_number().over(by_class)).where(F.col("_r") <= best).select("a", "b", "shared")
    own = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.size("elements").cast("long").alias("shared"))
    pairs = materialize(pairs.unionAll(own))
    sets = classes.select("cid", "elements", "heads")
    told = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("_x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("_y"), "heads"), "b")
        .select("a", "shared", F.array_min(F.array_intersect("_x", "_y")).alias("least"), F.explode("heads").alias("other"))
    )
    ranked = told.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "other"))).where(F.col("_r") <= best)
    lists = ranked.groupBy(F.col("a").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("_r", "shared", "other", "least"))).alias("list"))
    met = meet(members, lists, ["cid"], "id")
    others = F.slice(F.filter("list", lambda x: x["other"] != F.col("id")), 1, most)
    return met.select("id", F.posexplode(others).alias("rank", "x")).select(
        "id", F.col("x.other").alias("other"), F.col("x.shared").alias("shared"), F.col("x.least").alias("least"), (F.col("rank") + 1).alias("rank")
    )
