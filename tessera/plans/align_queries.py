"""Registered alignment queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align
from ..sources.fixtures import Tables

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
    """select d.doc_id as text_id, b.item_id as probe_id from documents d, benchmark b where strlen(substr(b.text, 21, 80)) >= 20 and contains(d.text, substr(b.text, 21, 80))"""
)
def containment_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = F.lit(0).alias("grp")
    return align.containment_join(t.documents.select(one, F.col("doc_id").alias("id"), "text"), t.benchmark.select(one, F.col("item_id").alias("id"), "text"))


_KEYS = " union all ".join(
    f"select id, {k} as size, 0 as kind, substr(text, length(text) - {k} + 1, {k}) as key from {{0}} where length(text) > {k}"
    f" union all select id, {k}, 1, substr(text, length(text) // 2 - {k // 2} + 1, {2 * (k // 2)}) from {{0}} where length(text) > {2 * k}"
    for k in (40, 30, 20, 15, 10)
)


@query(
    f"""with idx as (select doc_id as id, text from documents), prb as (select doc_id as id, text from documents),
 ik as ({_KEYS.format('idx')}), fi as (select size, key, min(id) as index_id from ik group by all), pk as ({_KEYS.format('prb')}),
 h as (select pk.id as probe_id, index_id, size, kind, row_number() over (partition by pk.id order by size desc, kind, index_id) as rn from pk join fi using (size, key))
 select probe_id, index_id, cast(size as int) as size, cast(kind as int) as kind from h where rn = 1"""
)
def cascade_key_join(spark, sf_dir):
    """Every document's first document with the same ending or middle, by keys of falling size."""
    texts = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    return align.cascade_join(texts, texts)


_TITLE = "select page_id as id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) as name from pages"
_FIRST = "select doc_id as id, array_to_string(string_split(text, ' ')[1:6], ' ') as name from documents"


@query(
    f"""with l as ({_TITLE}), r as ({_FIRST}),
 lk as (select id, name, string_split(name, ' ') as w from l), rk as (select id as other, name as other_name, string_split(name, ' ') as w from r),
 ex as (select l.id, min(other) as other from l join rk on name = other_name group by l.id),
 r1 as (select * from lk where id not in (select id from ex)),
 fo as (select a.id, other, row_number() over (partition by a.id order by case when len(a.w) >= 5 and len(b.w) >= 5 and a.w[1:5] = b.w[1:5] then 0 else 1 end, other) as rn
 from r1 a join rk b on len(a.w) >= 4 and len(b.w) >= 4 and a.w[1:4] = b.w[1:4]),
 r2 as (select * from r1 where id not in (select id from fo)),
 th as (select a.id, min(other) as other, count(distinct other) as n from r2 a join rk b on len(a.w) >= 3 and len(b.w) >= 3 and a.w[1:3] = b.w[1:3] group by a.id)
 select id, other, 'exact' as step from ex union all select id, other, 'four' from fo where rn = 1 union all select id, other, 'three' from th where n = 1"""
)
def prefix_name_match(spark, sf_dir):
    """Titles of pages against the first words of documents."""
    t = Tables(spark, sf_dir)
    titles = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("name"))
    firsts = t.documents.select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("name"))
    return align.prefix_match(titles, firsts)


@query(
    """with ch as (select source as grp, lang as chapter, min(doc_id) as low, max(doc_id) as high from documents group by all), hd as (select distinct source as grp, n_chars as page from documents where n_chars > 3000),
 a as (select *, row_number() over (partition by grp order by low, chapter) as rn from ch), b as (select *, row_number() over (partition by grp order by page) as rn from hd),
 s as (select a.grp, a.rn, page, unnest(generate_series(low, high)) as number from a join b on a.grp = b.grp and a.rn = b.rn)
 select grp, number, arg_max(page, rn) as page from s group by all"""
)
def ordinal_zip(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chapters = t.documents.groupBy(F.col("source").alias("grp"), F.col("lang").alias("chapter")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    headings = t.documents.where("n_chars > 3000").select(F.col("source").alias("grp"), F.col("n_chars").alias("page")).distinct()
    return align.ordinal_zip(chapters, headings)


@query(
    """select source, d.doc_id, last_value(l.doc_id ignore nulls) over (partition by source order by d.doc_id rows between unbounded preceding and current row) as anchor
 from documents d left join labels l on l.doc_id = d.doc_id"""
)
def asof_fill(spark, sf_dir):
    """The last labelled document at or before each document of a source."""
    t = Tables(spark, sf_dir)
    marked = t.documents.select("source", "doc_id").join(t.labels.select("doc_id", F.col("doc_id").alias("mark")), "doc_id", "left")
    return align.fill_backward(marked, "source", "doc_id", "mark", "anchor").select("source", "doc_id", "anchor")


@query(
    """with a as (select distinct source, d.doc_id as page from documents d join labels using (doc_id)), w as (select *, least(coalesce(lead(page) over (partition by source order by page), page + 20), page + 20) as stop from a)
 select w.source, w.page, stop, d.doc_id as member from w join documents d on d.source = w.source and d.doc_id >= w.page and d.doc_id < stop where stop > w.page"""
)
def next_boundary(spark, sf_dir):
    """Windows from each labelled document to the next of its source, and the documents in them."""
    t = Tables(spark, sf_dir)
    pages = t.documents.select("source", F.col("doc_id").alias("page"))
    anchors = pages.join(t.labels.select(F.col("doc_id").alias("page")), "page")
    return align.pages_in_windows(align.next_boundary(anchors, "source", "page"), pages, "source", "page")


@query(
    """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over w > 3600000000 then 1 else 0 end as g from events window w as (partition by user_id order by event_id))
 select user_id, event_id, cast(sum(g) over (partition by user_id order by event_id) as int) as session from g"""
)
def gap_sessions(spark, sf_dir):
    """Events of a user split where more than an hour passes."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.select("user_id", "event_id", at.alias("us"))
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("event_id")) > 3_600_000_000
    return align.gap_sessions(rows.withColumn("far", gap), "user_id", "event_id", F.col("far")).select("user_id", "event_id", "session")


@query(
    """with p as (select doc_id as key, quality as v, 0 as pr, 'labels' as origin from labels union all select doc_id, cast(n_chars as int), 1, 'documents' from documents),
 r as (select *, row_number() over (partition by key order by pr, v) as rn from p) select key, v as value, origin from r where rn = 1"""
)
def priority_merge(spark, sf_dir):
    """A value from the first of several mappings that has one."""
    t = Tables(spark, sf_dir)
    a = t.labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("value"))
    b = t.documents.select(F.col("doc_id").alias("key"), F.col("n_chars").cast("int").alias("value"))
    return align.merge_by_priority([("labels", a), ("documents", b)], ["key"], "value")


@query(
    """with a as (select conv_id, list(role order by turn) as c from conversations group by conv_id), b as (select conv_id, list(substr(role, 1, 3) order by turn) as c from conversations where turn < 6 group by conv_id)
 select conv_id, len(a.c) = len(b.c) as same_length, len(a.c) = len(b.c) and coalesce(list_bool_and(list_transform(list_zip(a.c, b.c), lambda x: contains(x[1], x[2]) or contains(x[2], x[1]))), true) as same from a join b using (conv_id)"""
)
def chain_compare(spark, sf_dir):
    """Two versions of a sequence of names, compared place by place."""
    t = Tables(spark, sf_dir)

    def seq(rows, column):
        ordered = F.array_sort(F.collect_list(F.struct("turn", column.alias("x"))))
        return rows.groupBy("conv_id").agg(F.transform(ordered, lambda s: s["x"]).alias("chain"))

    return align.compare_chains(seq(t.conversations, F.col("role")), seq(t.conversations.where("turn < 6"), F.substring("role", 1, 3)), "conv_id")
