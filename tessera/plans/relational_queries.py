"""Registered counts, groupings and state queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import overlap
from ..sources.fixtures import CHAIN_SQL, Tables, chains

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(
    """select (select count(*) from documents) as documents, (select count(*) from supplier) as nodes, (select count(*) from orders) as variants,
 (select count(*) from lineitem) as links, (select count(*) from embeddings where embedding is not null) as vectors"""
)
def stats_counts(spark, sf_dir):
    """One count of each table, as one row; an empty table counts 0."""
    t = Tables(spark, sf_dir)
    parts = [
        t.documents.agg(F.count("*").alias("documents")), t.supplier.agg(F.count("*").alias("nodes")), t.orders.agg(F.count("*").alias("variants")),
        t.lineitem.agg(F.count("*").alias("links")), t.embeddings.where("embedding is not null").agg(F.count("*").alias("vectors")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("select n_name, count(*) as variants from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def linked_group_count(spark, sf_dir):
    """A count grouped by an attribute two links away."""
    t = Tables(spark, sf_dir)
    rows = t.orders.select("o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("variants"))


@query(
    """select key, cast(sum(n) as bigint) as n from (select s_nationkey as key, count(*) as n from supplier group by all union all select c_nationkey, count(*) from customer group by all) group by key"""
)
def merge_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.count("*").alias("n"))
    b = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("key").agg(F.sum("n").alias("n"))


@query("select distinct event_type || ':' || (user_id % 5) as tag from events")
def distinct_tags(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tags = F.array(F.concat_ws(":", "event_type", (F.col("user_id") % 5).cast("string")))
    return t.events.select(F.explode(tags).alias("tag")).distinct()


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1")
def dedup_first(spark, sf_dir):
    """The first row of each key: one partial aggregate, no sort."""
    t = Tables(spark, sf_dir)
    first = t.events.groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("m"))
    return first.select("user_id", "m.event_id", "m.event_type")


@query(
    """select source, doc_id, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 3"""
)
def per_group_limit(spark, sf_dir):
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return t.documents.select("source", "doc_id", "n_chars").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query(
    """select 'lang' as field, round(count(nullif(lang, '')) * 100.0::double / count(*), 6) as coverage from documents union all
 select 'text', round(count(nullif(text, '')) * 100.0::double / count(*), 6) from documents union all
 select 'quality', round(count(quality) * 100.0::double / count(*), 6) from documents left join labels using (doc_id)"""
)
def field_coverage(spark, sf_dir):
    """Percentage of rows in which each field has a value, in one pass."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "lang", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    share = lambda c: F.round(F.count(c) * 100.0 / F.count("*"), 6)
    wide = rows.agg(share(F.nullif("lang", F.lit(""))).alias("lang"), share(F.nullif("text", F.lit(""))).alias("text"), share(F.col("quality")).alias("quality"))
    return wide.select(F.expr("stack(3, 'lang', lang, 'text', text, 'quality', quality) as (field, coverage)"))


@query(
    """with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), b as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT')
 select count(*) filter (where a.k is not null and b.k is not null) as both_sides, count(*) filter (where b.k is null) as left_only, count(*) filter (where a.k is null) as right_only
 from a full join b on a.k = b.k"""
)
def set_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("a")).distinct()
    b = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("b")).distinct()
    rows = a.join(b, F.col("a") == F.col("b"), "full")
    return rows.agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only")
    )


@query(
    f"""with {CHAIN_SQL}, own as (select distinct variant, node from chain), mine as (select node from own where variant = 1)
 select o.variant, count(*) as shared, list(o.node order by o.node) as nodes from own o where o.node in (select node from mine) and o.variant <> 1 group by o.variant order by shared desc, o.variant limit 50"""
)
def shared_neighbours(spark, sf_dir):
    """Variants that share nodes with one variant, itself excluded."""
    own = chains(Tables(spark, sf_dir)).select("variant", "node").distinct()
    mine = own.where("variant = 1").select("node")
    rows = own.where("variant <> 1").join(mine, "node", "left_semi")
    return (
        rows.groupBy("variant").agg(F.count("*").alias("shared"), F.sort_array(F.collect_list("node")).alias("nodes"))
        .orderBy(F.desc("shared"), "variant").limit(50)
    )


@query(
    """select d.doc_id, d.source, l.quality, coalesce(b.item_id, -1) as item_id, count(c.turn) as turns from documents d join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id
 left join conversations c on c.conv_id = d.doc_id group by all"""
)
def assemble_left(spark, sf_dir):
    """A required side, an optional single row and an optional list, assembled by id."""
    t = Tables(spark, sf_dir)
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("turn").alias("turns"))
    rows = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id")
    rows = rows.join(t.benchmark.select(F.col("item_id").alias("doc_id"), "item_id"), "doc_id", "left").join(turns, "doc_id", "left")
    return rows.select("doc_id", "source", "quality", F.coalesce("item_id", F.lit(-1).cast("bigint")).alias("item_id"), F.coalesce("turns", F.lit(0).cast("bigint")).alias("turns"))


@query(
    """with e as (select *, cast(json_extract(props, '$.k') as bigint) as k, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
 select user_id, event_type, event_id, k, round(value, 6) as value from e where rn = 1"""
)
def note_last_state(spark, sf_dir):
    """The last write of each key: a partial aggregate, no sort."""
    t = Tables(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    last = t.events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", k.alias("k"), "value")).alias("m"))
    return last.select("user_id", "event_type", "m.event_id", "m.k", F.round("m.value", 6).alias("value"))


@query(
    """with e as (select user_id, cast(json_extract(props, '$.k') as bigint) as ref, event_type, ts, event_id from events)
 select ref, count(*) as notes, arg_min(event_type, (ts, event_id)) as color, cast(max(epoch_us(ts)) as bigint) as last_us from e group by ref"""
)
def bulk_note_refs(spark, sf_dir):
    """Notes grouped by what they refer to; the earliest one's colour stands for all."""
    t = Tables(spark, sf_dir)
    rows = t.events.withColumn("ref", F.get_json_object("props", "$.k").cast("bigint"))
    return rows.groupBy("ref").agg(
        F.count("*").alias("notes"), F.min_by("event_type", F.struct("ts", "event_id")).alias("color"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us")
    )


@query(
    """with n as (select distinct o_custkey as id from orders where o_orderpriority = '1-URGENT'), u as (select c_custkey as id, c_name as name, case when n.id is not null then upper(c_name) end as new_name from customer left join n on n.id = c_custkey)
 select id, coalesce(new_name, name) as name, new_name is not null as changed from u where id in (select o_custkey from orders)"""
)
def partial_update(spark, sf_dir):
    """Copy on write: rows that match are merged field by field, rows of a predicate are gone."""
    t = Tables(spark, sf_dir)
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")).distinct()
    new = old.join(urgent, "id", "left_semi").select("id", F.upper("name").alias("new_name"))
    live = t.orders.select(F.col("o_custkey").alias("id"))
    rows = old.join(live, "id", "left_semi").join(new, "id", "left")
    return rows.select("id", F.coalesce("new_name", "name").alias("name"), F.col("new_name").isNotNull().alias("changed"))


@query(
    """select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"""
)
def resume_pending(spark, sf_dir):
    """What a resumed job has still to do: keys without a result."""
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query(
    """select o_orderpriority as category, count(*) as n, round(sum(o_totalprice), 2) as total, rank from (select *, dense_rank() over (order by o_orderpriority) as rank from orders) group by all""".replace(
        "dense_rank() over (order by o_orderpriority) as rank", "cast(substr(o_orderpriority, 1, 1) as int) as rank"
    )
)
def category_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.orders.groupBy(F.col("o_orderpriority").alias("category"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"))
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select p_brand as key, list(distinct p_size order by p_size) as parts, count(*) as holders from part group by p_brand")
def reverse_map(spark, sf_dir):
    """From element to its holders: the distinct sizes that parts of a brand have."""
    p = Tables(spark, sf_dir).part
    return p.groupBy(F.col("p_brand").alias("key")).agg(F.sort_array(F.collect_set("p_size")).alias("parts"), F.count("*").alias("holders"))


@query(
    f"""with {CHAIN_SQL}, own as (select distinct family, variant, node from chain)
 select a.family, a.variant as a, b.variant as b, count(*) as shared from own a join own b on a.family = b.family and a.node = b.node and a.variant < b.variant group by all having count(*) >= 2"""
)
def set_overlap_join(spark, sf_dir):
    """Variants of one family with at least two common nodes, through the nodes instead of all pairs."""
    own = chains(Tables(spark, sf_dir)).select("family", "variant", "node").distinct()
    return overlap.at_least(own, "family", "variant", "node", 2).select("family", "a", "b", "shared")


@query(
    """select n_name, coalesce(s, 0) as suppliers, coalesce(c, 0) as customers from nation left join (select s_nationkey k, count(*) s from supplier group by all) x on x.k = n_nationkey
 left join (select c_nationkey k, count(*) c from customer group by all) y on y.k = n_nationkey order by (n_name <> 'CHINA'), n_name"""
)
def default_first(spark, sf_dir):
    """An ordering that puts the default first."""
    t = Tables(spark, sf_dir)
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    rows = t.nation.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint")).alias(x)
    return rows.orderBy(F.col("n_name") != "CHINA", "n_name").select("n_name", zero("suppliers"), zero("customers"))
