"""The engine's domain views over the star-schema tables: nodes, chains and their edges.

A supplier is a node, an order a variant (a recorded text), a customer's orders a family of
variants, and the lines of an order, in order, the chain of nodes that handed it down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Tables of one directory by name, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def nodes(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("n_regionkey") + 1).cast("int").alias("gen")
    )


def chains(t: Tables) -> DataFrame:
    """variant, family, node, gen, pos: one row for each place of a chain."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    placed = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    return (
        placed.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(nodes(t), F.col("l_suppkey") == F.col("id"))
        .select(
            F.col("l_orderkey").alias("variant"), F.col("o_custkey").alias("family"), F.col("l_suppkey").alias("node"), "gen", "pos"
        )
    )


#: The same views in SQL, as common table expressions in order of use.
NODE_SQL = "node as (select s_suppkey as id, s_name as name, cast(n_regionkey + 1 as int) as gen from supplier join nation on s_nationkey = n_nationkey)"
CHAIN_SQL = (
    NODE_SQL
    + """, chain as (select l_orderkey as variant, o_custkey as family, l_suppkey as node, gen, cast(pos as int) as pos
 from (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey) - 1 as pos from lineitem) l
 join orders on l_orderkey = o_orderkey join node on l_suppkey = node.id)"""
)
EDGE_SQL = (
    CHAIN_SQL
    + """, step as (select *, lead(node) over w as node2, lead(gen) over w as gen2 from chain window w as (partition by variant order by pos)),
 edge as (select family, variant, node as src, node2 as dst, gen as src_gen, gen2 as dst_gen, pos from step
 where node2 is not null and node <> node2 and not (gen2 >= gen + 2 or (gen = 1 and gen2 > 1)))"""
)
