"""Chains, edges and reachability inside families of variants.

Inputs: chains (family, variant, node, gen, pos) and edges (family, variant, src, dst, ...),
src having heard from dst. All operators work on all families at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .storage import materialize


def chain_steps(chains: DataFrame) -> DataFrame:
    """chains with dst and dst_gen, the next node of the chain and its generation."""
    w = Window.partitionBy("variant").orderBy("pos")
    return chains.withColumns({"dst": F.lead("node").over(w), "dst_gen": F.lead("gen").over(w)})


def step_edges(steps: DataFrame) -> DataFrame:
    """Edges between neighbours of a chain; none to oneself, over a generation gap, or from the first generation to a later one."""
    skip = F.coalesce((F.col("dst_gen") >= F.col("gen") + 2) | ((F.col("gen") == 1) & (F.col("dst_gen") > 1)), F.lit(False))
    return steps.where(F.col("dst").isNotNull() & (F.col("node") != F.col("dst")) & ~skip).select(
        "family", "variant", F.col("node").alias("src"), "dst", F.col("gen").alias("src_gen"), "dst_gen", "pos"
    )


def chain_edges(chains: DataFrame) -> DataFrame:
    """The edges of chains, as step_edges takes them."""
    return step_edges(chain_steps(chains))


def split_by_gap(chains: DataFrame, least: int = 2) -> DataFrame:
    """chains with part: a new part begins where the generation rises by at least `least`."""
    w = Window.partitionBy("variant").orderBy("pos")
    jump = F.coalesce(F.col("gen") >= F.lag("gen").over(w) + least, F.lit(False)).cast("int")
    return chains.withColumn("_jump", jump).withColumn("part", F.sum("_jump").over(w).cast("int")).drop("_jump")


def last_position_edges(chains: DataFrame) -> DataFrame:
    """Neighbour edges of which both ends stand at their last place in the chain."""
    w = Window.partitionBy("variant").orderBy("pos")
    last = Window.partitionBy("variant", "node")
    rows = chains.withColumn("_last", F.max("pos").over(last) == F.col("pos"))
    rows = rows.withColumns({"dst": F.lead("node").over(w), "_next": F.lead("_last").over(w)})
    return rows.where(F.col("_last") & F.col("_next") & (F.col("node") != F.col("dst"))).select("family", "variant", F.col("node").alias("src"), "dst", "pos")


def carry_forward(chains: DataFrame, value: Column, real: Column, name: str) -> DataFrame:
    """chains with the last real value at or before each place."""
    w = Window.partitionBy("variant").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return chains.withColumn(name, F.last(F.when(real, value), ignorenulls=True).over(w))


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("family", "src", "dst").distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(family, src, dst): all dst that src reaches by one step or more; cycles include src itself. For those who want the pairs; see bitmaps.reach."""
    return bitmaps.reach(edges).pairs()


def reachable(closed: DataFrame) -> DataFrame:
    """closure without a node's way back to itself."""
    return closed.where("src <> dst")


def families_of_two_or_more(chains: DataFrame) -> DataFrame:
    """(family) with at least two variants; a lone variant has no family graph."""
    return chains.groupBy("family").agg(F.count_distinct("variant").alias("_n")).where("_n > 1").select("family")


def of_two_or_more(chains: DataFrame) -> DataFrame:
    """chains of families with at least two variants."""
    return chains.join(families_of_two_or_more(chains), "family", "left_semi")


def memberships(chains: DataFrame) -> DataFrame:
    return chains.select("family", "variant", "node").distinct()


def family_nodes(chains: DataFrame) -> DataFrame:
    return chains.groupBy("family", "node").agg(F.max("gen").alias("gen"))


def degrees(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(family, node, gen, teachers, students): distinct neighbours in the family."""
    one = distinct_edges(edges)
    teachers = one.groupBy("family", F.col("src").alias("node")).agg(F.count("*").alias("teachers"))
    students = one.groupBy("family", F.col("dst").alias("node")).agg(F.count("*").alias("students"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        family_nodes(chains).join(teachers, ["family", "node"], "left").join(students, ["family", "node"], "left")
        .select("family", "node", "gen", zero("teachers"), zero("students"))
    )


def chronology_ratio(edges: DataFrame) -> DataFrame:
    """Per family and node the share of its edges on which the student's generation is the earlier one."""
    conflict = F.coalesce(F.col("src_gen") < F.col("dst_gen"), F.lit(False)).cast("double")
    ends = F.explode(F.array_distinct(F.array("src", "dst")))
    return edges.select("family", ends.alias("node"), conflict.alias("conflict")).groupBy("family", "node").agg(
        F.count("*").alias("edges"), F.avg("conflict").alias("ratio")
    )


def shortest_paths(edges: DataFrame, start: int, most_levels: int = 6) -> DataFrame:
    """(node, level, parent, path) of all nodes within most_levels undirected steps of start.

    edges: (src, dst). On one level an outward edge comes before an inward one, then the
    lesser parent. Each level joins the frontier alone with the edges.
    """
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("inward"))
    both = materialize(out.unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(1).alias("inward"))).where("a <> b").distinct())
    seen = materialize(
        edges.sparkSession.range(1).select(
            F.lit(start).cast("bigint").alias("node"), F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent"),
            F.array(F.lit(start).cast("bigint")).alias("path"),
        )
    )
    frontier = seen
    for level in range(1, most_levels + 1):
        step = frontier.join(both, frontier["node"] == both["a"]).select(
            F.col("b").alias("node"), F.struct("inward", F.col("a").alias("parent")).alias("by"), "path"
        )
        new = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(
            F.min("by").alias("by"), F.min_by("path", "by").alias("path")
        )
        frontier = materialize(
            new.select("node", F.lit(level).alias("level"), F.col("by.parent").alias("parent"), F.concat("path", F.array("node")).alias("path"))
        )
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionAll(frontier))
    return seen


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) over undirected edges (a, b): the least node of each component."""
    ends = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are worked out once
    both = materialize(edges.where("a <> b").select(ends).distinct())
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(most_rounds):
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("component").alias("best"))
        # all nodes of a label take the least label beside any of them, and then the one that this label takes itself
        hooks = label.join(near, label["node"] == near["a"], "left").groupBy("component").agg(F.least("component", F.min("best")).alias("hook"))
        hop = hooks.select(F.col("component").alias("hook"), F.col("hook").alias("further"))
        hooks = hooks.join(hop, "hook", "left").select("component", F.least("hook", "further").alias("new"))
        new = materialize(label.join(hooks, "component").select("node", "component", "new"))
        label = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return label
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")


def induced_edges(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(family, variant, src, dst): the family's edges, whichever variant they come from, between two nodes of each variant."""
    member = memberships(chains)
    starts = member.withColumnRenamed("node", "src").join(distinct_edges(edges), ["family", "src"])
    return starts.join(member.withColumnRenamed("node", "dst"), ["family", "variant", "dst"], "left_semi").select("family", "variant", "src", "dst")


def first_neighbours(edges: DataFrame, node: str, other: str, most: int = 25) -> DataFrame:
    """(node, shown, total): of distinct edges, each node's first `most` neighbours and how many it has.

    Neighbours are ranked before they are gathered, and every task of the ranking passes on `most` of a node at
    most, so that no list of a hub is ever longer.
    """
    place = F.row_number().over(Window.partitionBy("node").orderBy("other"))
    one = edges.select(F.col(node).alias("node"), F.col(other).alias("other"))
    first = one.withColumn("_place", place).where(F.col("_place") <= most).groupBy("node").agg(F.sort_array(F.collect_list("other")).alias("shown"))
    return first.join(one.groupBy("node").agg(F.count("*").alias("total")), "node").select("node", "shown", "total")


def ego_graphs(nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """(node, teachers, students, total_teachers, total_students, links) for each of nodes (node).

    edges: distinct (src, dst), src having heard from dst. The first `most` of either side are shown; links:
    (src, dst) of all edges between any two nodes that are shown, the middle one included. Pairs of shown nodes,
    of which a graph has no more than their bound, look for their edge; a hub's edges are not listed.
    """
    up = first_neighbours(edges, "src", "dst", most).select("node", F.col("shown").alias("teachers"), F.col("total").alias("total_teachers"))
    down = first_neighbours(edges, "dst", "src", most).select("node", F.col("shown").alias("students"), F.col("total").alias("total_students"))
    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")
    shown = materialize(
        nodes.select("node").join(up, "node", "left").join(down, "node", "left").select(
            "node", F.coalesce("teachers", none).alias("teachers"), F.coalesce("students", none).alias("students"),
            F.coalesce("total_teachers", zero).alias("total_teachers"), F.coalesce("total_students", zero).alias("total_students"),
        )
    )
    each = F.array_union(F.array("node"), F.array_union("teachers", "students"))
    pairs = shown.select("node", each.alias("_all")).select("node", "_all", F.explode("_all").alias("src")).select("node", "src", F.explode("_all").alias("dst"))
    links = pairs.where("src <> dst").join(edges, ["src", "dst"], "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("links"))
    return shown.join(links, "node", "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<src:bigint,dst:bigint>>")))


def greedy_walks(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """(family, variant, step, node): a walk inside each variant from its least leaf by least unvisited teacher to a root.

    It goes along the family's edges between members of the variant. A leaf has no students among them. A variant without a leaf (a
    cycle) lists its nodes in order.
    """

    def walk(family, variant, nodes, steps):
        teachers: dict = {}
        for s, d in steps:
            teachers.setdefault(s, set()).add(d)
        students = {d for _, d in steps}
        path = sorted(nodes)
        leaves = [n for n in path if n not in students]
        if leaves:
            path, here = [], leaves[0]
            while here is not None:
                path.append(here)
                here = min((t for t in teachers.get(here, ()) if t not in path), default=None)
        return [(family, variant, i, n) for i, n in enumerate(path)]

    def run(batches):
        import pandas as pd

        key, nodes, steps, out = None, set(), [], []
        for pdf in batches:
            for family, variant, node, dst in zip(pdf["family"], pdf["variant"], pdf["node"], pdf["dst"]):
                if (family, variant) != key:
                    if key:
                        out += walk(*key, nodes, steps)
                    key, nodes, steps = (family, variant), set(), []
                nodes.add(node)
                if dst >= 0:
                    steps.append((node, dst))
            yield pd.DataFrame(out, columns=["family", "variant", "step", "node"])
            out = []
        if key:
            yield pd.DataFrame(walk(*key, nodes, steps), columns=["family", "variant", "step", "node"])

    inside = induced_edges(chains, edges).withColumnRenamed("src", "node")
    rows = memberships(chains).join(inside, ["family", "variant", "node"], "left")
    rows = rows.select("family", "variant", "node", F.coalesce("dst", F.lit(-1)).alias("dst"))
    # one pass over sorted partitions: a variant's rows follow each other, however batches cut them
    sorted_rows = rows.repartition("family", "variant").sortWithinPartitions("family", "variant", "node", "dst")
    return sorted_rows.mapInPandas(run, "family bigint, variant bigint, step int, node bigint")
