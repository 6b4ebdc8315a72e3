"""Distributed connected components: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut
from .totals import each_salt, salt, salts_seen


def _least(rows: DataFrame, meets: DataFrame, where: str) -> DataFrame:
    """meets (u, v, part) with m, the least v of u in rows; parts keep a hub's rows from one task."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), salts_seen(F.expr(where), F.col("part")).alias("seen"))
    return meets.join(least.select("u", "m", each_salt(F.col("seen")).alias("part")), ["u", "part"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    Large: every vertex ties its greater neighbours to its least neighbour (or itself).
    Small: every vertex ties its lesser neighbours and itself to the least of them.
    """
    down = edges.select("u", "v", salt("v").alias("part"))
    if large:
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), salt("u").alias("part"))
        out = _least(down.unionAll(up), up, "v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        # the edge to the least itself ties u, every other one its v
        out = _least(down, down, "true").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) with u > v are stars around their least vertices."""
    ends = F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"))))
    of = edges.select(ends).groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return of.where("up > 1 or (up = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) of every vertex of edges (a, b); the component is its least vertex.

    Works on any orderable type. Loops, repeated edges and nulls are ignored; no edges give no
    rows. Each round is two grouped minima and joins on edges alone. Minima are summed before
    they are shuffled, and meet the edges of a vertex in parts, so a vertex with a third of all
    edges does not meet them in one task. Rounds grow with the logarithm of the longest path;
    each is checkpointed in the shared folder.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    rounds = 0
    while not _settled(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"components have not settled after {most_rounds} rounds")
        edges, rounds = cut(_stars(_stars(edges, large=True), large=False).distinct()), rounds + 1
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )
