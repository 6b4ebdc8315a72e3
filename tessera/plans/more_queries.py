"""Further registered queries: lookups, pointers, pages of neighbours, small text forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import search
from ..sources.fixtures import Tables
from .search_queries import COSINE

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
    """with w as (select source, lang, doc_id, unnest(string_split(text, ' ')) as word from documents)
 select source, count(*) as occurrences, count(distinct (lang, doc_id)) as documents from w where word = 'the' group by source"""
)
def root_search(spark, sf_dir):
    """All occurrences of a word and the distinct documents they stand in, per source."""
    t = Tables(spark, sf_dir)
    words = t.documents.select("source", "lang", "doc_id", F.explode(F.split("text", " ")).alias("word")).where("word = 'the'")
    return words.groupBy("source").agg(F.count("*").alias("occurrences"), F.count_distinct("lang", "doc_id").alias("documents"))


@query("select item_id, coalesce(nullif(array_to_string(string_split(text, ' ')[3:5], ' '), ''), text) as words from benchmark")
def word_range_lookup(spark, sf_dir):
    """A range of words, from the words' own table if it has them, else from the split text."""
    t = Tables(spark, sf_dir)
    table = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w")).where("i between 2 and 4")
    stored = table.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("stored"))
    return t.benchmark.join(stored, "item_id", "left").select("item_id", F.coalesce(F.nullif("stored", F.lit("")), "text").alias("words"))


@query(
    """with e as (select *, cast(json_extract(props, '$.k') as bigint) as k from events)
 select a.event_id, round(case when a.event_type = 'error' then b.value else a.value end, 6) as value, a.event_type = 'error' as by_reference from e a left join events b on a.event_type = 'error' and b.event_id = a.k"""
)
def reference_resolution(spark, sf_dir):
    """A row holds its value or points to the row that does; one level is resolved."""
    t = Tables(spark, sf_dir)
    points = F.col("event_type") == "error"
    a = t.events.select("event_id", "value", points.alias("by_reference"), F.when(points, F.get_json_object("props", "$.k").cast("bigint")).alias("k"))
    b = t.events.select(F.col("event_id").alias("k"), F.col("value").alias("pointed"))
    rows = a.join(b, "k", "left")
    return rows.select("event_id", F.round(F.when(F.col("by_reference"), F.col("pointed")).otherwise(F.col("value")), 6).alias("value"), "by_reference")


@query(
    """select 'documents' as only_in, doc_id from documents where doc_id not in (select doc_id from labels) union all select 'labels', doc_id from labels where doc_id not in (select doc_id from documents)"""
)
def two_way_difference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.join(b, "doc_id", "left_anti").select(F.lit("documents").alias("only_in"), "doc_id").unionAll(b.join(a, "doc_id", "left_anti").select(F.lit("labels"), "doc_id"))


@query("select conv_id, turn, coalesce(nullif(trim(text), ''), role, '') as shown, text is not null as has_text from conversations")
def display_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.nullif(F.trim("text"), F.lit("")), "role", F.lit("")).alias("shown"), F.col("text").isNotNull().alias("has_text"))


@query(
    """with w as (select item_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as pos from benchmark)
 select item_id, cast(pos as int) as pos, word, case when pos = 1 then 'item ' || item_id end as label from w"""
)
def first_word_attribute(spark, sf_dir):
    """Only a group's first word carries the group's attribute."""
    t = Tables(spark, sf_dir)
    rows = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("i", "word"))
    return rows.select("item_id", (F.col("i") + 1).alias("pos"), "word", F.when(F.col("i") == 0, F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("label"))


@query(
    f"""with s as (select e.vec_id as id, round({COSINE}, 9) as score, e.label = q.label as same_label from embeddings e, embeddings q where q.vec_id = 0 and e.vec_id <> 0)
 select id as vec_id, round(score, 6) as score, same_label from s order by s.score desc, id limit 5 offset 5"""
)
def neighbours_page(spark, sf_dir):
    """The second page of a stored row's neighbours, itself left out."""
    t = Tables(spark, sf_dir)
    row = t.embeddings.where("vec_id = 0").select("embedding", "label").first()
    near = search.knn(t.embeddings.where("vec_id <> 0"), "vec_id", "embedding", row[0]).withColumn("score", F.round("score", 9))
    page = near.orderBy(F.desc("score"), "id").offset(5).limit(5)
    label = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") == row[1]).alias("same_label"))
    return page.join(label, "id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "same_label")


@query(
    f"""with s as (select a.vec_id as id, b.vec_id as other, a.label, row_number() over (partition by a.vec_id order by round({COSINE.replace('e.embedding', 'b.embedding').replace('q.embedding', 'a.embedding')}, 12) desc, b.vec_id) as rank from embeddings a, embeddings b),
 n as (select s.*, x.label as other_label from s join embeddings x on x.vec_id = other where rank <= 6 and id <> other)
 select id, count(*) as near, count(*) filter (where label = other_label) as same_label, list(other order by rank) as others from n group by id"""
)
def similar_bundle(spark, sf_dir):
    """Each row's nearest others, how many share its label, in order."""
    t = Tables(spark, sf_dir)
    near = search.neighbours(t.embeddings, "vec_id", "embedding", 6).where("id <> other")
    label = t.embeddings.select("vec_id", "label")
    rows = near.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("x")), "id").join(label.select(F.col("vec_id").alias("other"), F.col("label").alias("y")), "other")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda s: s["other"])
    return rows.groupBy("id").agg(F.count("*").alias("near"), F.count_if(F.col("x") == F.col("y")).alias("same_label"), ordered.alias("others"))


@query(
    """select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/', '_') as file, split_part(url, '?', 1) as address, lower(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-')) as slug from pages"""
)
def url_forms(spark, sf_dir):
    """A file name with the first slash replaced, the address without its query, a slug."""
    t = Tables(spark, sf_dir)
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return t.pages.select("page_id", F.regexp_replace(bare, "^([^/]*)/", "$1_").alias("file"), F.split_part("url", F.lit("?"), F.lit(1)).alias("address"), fx.latin_slug(F.col("url")).alias("slug"))


@query("select url, max(page_id) as page_id, count(*) as fetched from pages group by url")
def preview_cache(spark, sf_dir):
    """A cache by address: the last fetch of each."""
    t = Tables(spark, sf_dir)
    return t.pages.groupBy("url").agg(F.max("page_id").alias("page_id"), F.count("*").alias("fetched"))


@query(
    """select user_id, event_id, event_type, n from (select *, row_number() over (partition by user_id order by md5('7:' || event_id), event_id) as n from events) where n <= 3"""
)
def seeded_sample(spark, sf_dir):
    """Three events of each user in an order fixed by a seed: the sampling operator itself."""
    t = Tables(spark, sf_dir)
    order = F.md5(F.concat(F.lit("7:"), F.col("event_id").cast("string")).cast("binary"))
    rows = t.events.select("user_id", "event_id", "event_type", order.alias("h")).withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("h", "event_id")))
    return rows.where("n <= 3").select("user_id", "event_id", "event_type", F.col("n").cast("bigint").alias("n"))


@query(
    """select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as spread from events group by all""".replace(
        "date_trunc('hour', ts) as hour", "strftime(ts, '%Y-%m-%dT%H:00:00Z') as hour"
    )
)
def hourly_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    hour = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:00:00'Z'")
    return t.events.groupBy(hour.alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"))
