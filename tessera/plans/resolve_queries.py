"""Registered lookups, resolutions and guards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, resolve, scan, skew
from ..sources import seeds
from ..sources.fixtures import Tables
from .text_queries import _DECODE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_REFS = "r as (select event_id, event_type as collection, user_id * 3 % 40 as number from events), d as (select case event_type when 'click' then 'click' else event_type end as collection, user_id as number, min(event_id) as id from events where user_id % 4 <> 0 group by all)"


@query(f"with {_REFS} select event_id, collection, number, d.id, d.id is not null as matched from r left join d using (collection, number)")
def two_key_resolve(spark, sf_dir):
    """References by collection and number, matched and not."""
    e = Tables(spark, sf_dir).events
    refs = e.select("event_id", F.col("event_type").alias("collection"), (F.col("user_id") * 3 % 40).alias("number"))
    records = e.where("user_id % 4 <> 0").select(F.col("event_type").alias("collection"), F.col("user_id").alias("number"), F.col("event_id").alias("id"))
    matched, rest = resolve.resolve_pairs(refs, records, ("collection", "number"))
    columns = ["event_id", "collection", "number", "id"]
    rows = matched.select(*columns, F.lit(True).alias("matched"))
    return rows.unionAll(rest.select("event_id", "collection", "number", F.lit(None).cast("bigint"), F.lit(False)))


_PEOPLE = """forms as (select c_custkey as other, unnest(['person ' || c_custkey % 300, 'son of ' || c_nationkey || ' ' || c_mktsegment || ' ' || c_custkey % 300, c_name]) as form, 'son of ' || c_nationkey || ' ' || c_mktsegment || ' ' || c_custkey as name from customer),
 names as (select s_suppkey as id, case s_suppkey % 4 when 0 then 'person ' || s_suppkey when 1 then 'Customer#' || lpad(s_suppkey::varchar, 9, '0') when 2 then 'see Customer#' || lpad(s_suppkey::varchar, 9, '0') || ' there' else 'nobody' end as short,
 case s_suppkey % 4 when 0 then 'son of ' || c_nationkey || ' ' || c_mktsegment || ' ' || c_custkey || ' x' else s_name end as "full" from supplier join customer on c_custkey = s_suppkey)"""


@query(
    f"""with {_PEOPLE}, asked as (select distinct id, unnest([short, "full"]) as form from names), ex as (select distinct id, other from asked join forms using (form)), exn as (select *, count(*) over (partition by id) as n from ex),
 pe as (select distinct other, name from forms), o as (select exn.id, exn.other, length("full") > 10 and (contains("full", name) or contains(name, "full") or (len(string_split("full", ' ')) >= 3 and string_split("full", ' ')[1:3] = string_split(name, ' ')[1:3])) as fits from exn join names using (id) join pe using (other) where n > 1),
 m as (select *, max(fits::int) over (partition by id) as fitting from o), nr as (select id, count(distinct other) as candidates, min(other) as other from m where fits or fitting = 0 group by id),
 own as (select form, min(other) as other from forms where length(form) > 8 group by form having count(distinct other) = 1), rest as (select asked.* from asked where length(form) >= 8 and id not in (select id from ex)),
 h as (select distinct rest.id, own.other from rest join own on contains(rest.form, own.form) or contains(own.form, rest.form)), hp as (select id, count(*) as candidates, min(other) as other from h group by id),
 done as (select id, other, 'exact' as step, 1 as candidates from exn where n = 1 union all select id, case when candidates = 1 then other end, 'filtered', candidates from nr union all select id, case when candidates = 1 then other end, 'substring', candidates from hp)
 select * from done union all select id, null, 'none', 0 from names where id not in (select id from done)"""
)
def three_pass_resolve(spark, sf_dir):
    """Names to people: exact, then filtered by further signals, then by parts; what stays ambiguous is said."""
    t = Tables(spark, sf_dir)
    c = t.customer
    full = F.concat_ws(" ", F.lit("son of"), "c_nationkey", "c_mktsegment", "c_custkey")
    listed = F.array(F.format_string("person %d", F.col("c_custkey") % 300), F.concat_ws(" ", F.lit("son of"), "c_nationkey", "c_mktsegment", (F.col("c_custkey") % 300).cast("string")), F.col("c_name"))
    forms = c.select(F.col("c_custkey").alias("other"), F.explode(listed).alias("form"), full.alias("name"))
    code = F.format_string("Customer#%09d", "s_suppkey")
    kind = F.col("s_suppkey") % 4
    short = F.when(kind == 0, F.format_string("person %d", "s_suppkey")).when(kind == 1, code).when(kind == 2, F.concat(F.lit("see "), code, F.lit(" there"))).otherwise("nobody")
    rows = t.supplier.join(c, F.col("c_custkey") == F.col("s_suppkey"))
    names = rows.select(F.col("s_suppkey").alias("id"), short.alias("short"), F.when(kind == 0, F.concat(full, F.lit(" x"))).otherwise(F.col("s_name")).alias("full"))
    return resolve.resolve_names(names, forms)


@query(
    """with s as (select conv_id, turn, string_split(text, ' ') as ws from conversations where turn % 2 = 0)
 select c.conv_id, c.turn, array_to_string(coalesce(s.ws, string_split(c.text, ' '))[2:4], ' ') as words, s.ws is not null as stored from conversations c left join s using (conv_id, turn)"""
)
def word_range_fallback(spark, sf_dir):
    """Words 2 to 4 of a turn from the table of words, which has even turns alone, else from its split text."""
    c = Tables(spark, sf_dir).conversations
    words = c.where("turn % 2 = 0").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    ranged = F.transform(F.array_sort(F.collect_list(F.when(F.col("i").between(1, 3), F.struct("i", "w")))), lambda x: x["w"])
    stored = words.groupBy("conv_id", "turn").agg(F.array_join(ranged, " ").alias("stored"))
    rows = c.join(stored, ["conv_id", "turn"], "left")
    split = F.array_join(F.slice(F.split("text", " "), 2, 3), " ")
    return rows.select("conv_id", "turn", F.coalesce("stored", split).alias("words"), F.col("stored").isNotNull().alias("stored"))


@query(
    """with h as (select source as book, doc_id as page, 'heading ' || doc_id as title from documents where n_chars % 5 = 0), e as (select source as book, max(doc_id) + 1 as stop from documents group by source)
 select book, title, page as first, coalesce(lead(page) over (partition by book order by page), stop) - 1 as last from h join e using (book)"""
)
def heading_bounds(spark, sf_dir):
    """Each heading's pages: from its own to the one before the next heading, the last to the book's end."""
    d = Tables(spark, sf_dir).documents
    ends = d.groupBy(F.col("source").alias("book")).agg((F.max("doc_id") + 1).alias("stop"))
    heads = d.where("n_chars % 5 = 0").select(F.col("source").alias("book"), F.col("doc_id").alias("first"), F.format_string("heading %d", "doc_id").alias("title"))
    ahead = skew.meet(scan.following(heads, "book", "first", "next"), ends, ["book"], "first")
    return ahead.select("book", "title", "first", (F.coalesce("next", "stop") - 1).alias("last"))


@query(
    """with c as (select p_partkey, p_name, p_type, p_size from part where p_size between 10 and 30), r as (select *, case when p_type like 'STANDARD%' then 0 when p_type like 'SMALL%' then 1 else 2 end as category from c)
 select p_partkey, category, row_number() over (order by category, p_size desc, p_partkey) as place from r"""
)
def category_order(spark, sf_dir):
    """A filtered list in an order of categories of one's own, numbered over the whole order without one task for all rows."""
    from ..operators.order import numbered

    p = Tables(spark, sf_dir).part.where("p_size between 10 and 30")
    category = F.when(F.col("p_type").startswith("STANDARD"), 0).when(F.col("p_type").startswith("SMALL"), 1).otherwise(2)
    rows = p.select("p_partkey", category.alias("category"), "p_size")
    return numbered(rows, "place", F.col("category"), F.desc("p_size"), F.col("p_partkey")).select("p_partkey", "category", "place")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100 offset 200")
def clamped_page(spark, sf_dir):
    """The third page of a caller who asked for 500 rows to a page: pages end at 100."""
    skip, size = guards.page_bounds(3, 500)
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(skip).limit(size)


@query("select (select len(embedding) from embeddings where embedding is not null limit 1) as length, count(*) as stored, count(*) filter (where len(embedding) <> (select len(embedding) from embeddings where embedding is not null limit 1)) as others from embeddings where embedding is not null")
def dimension_probe(spark, sf_dir):
    """The length of stored vectors by a one-row probe, and how many have another."""
    v = Tables(spark, sf_dir).embeddings
    length = guards.vector_length(v, "embedding")
    stored = v.where("embedding is not null")
    return stored.agg(F.lit(length).alias("length"), F.count("*").alias("stored"), F.count_if(F.size("embedding") != F.lit(length)).alias("others"))


@query("select c_custkey as id, case when c_custkey % 7 = 0 then 'text of ' || c_custkey end as text_en from customer where c_custkey <= 100000")
def guarded_update(spark, sf_dir):
    """A field that a caller names is updated only if it is on the list."""
    table, field = guards.updatable("hadith", "text_en")
    rows = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"))
    return rows.select("id", F.when(F.col("id") % 7 == 0, F.format_string("text of %d", "id")).alias(field))


@query(f"""with v as (select unnest([{', '.join(map(str, seeds.VERSES))}]) as verses, unnest(range(1, 115)) as chapter), f as (select chapter, verses, sum(verses) over (order by chapter) - verses + 1 as first from v),
 e as (select event_id, event_id % 6236 + 1 as place from events) select event_id, cast(chapter as int) as chapter, cast(place - first + 1 as bigint) as verse from e join f on place between first and first + verses - 1""")
def verse_places(spark, sf_dir):
    """The chapter and verse of a verse's number in the whole book, from the seeded chapters."""
    e = Tables(spark, sf_dir).events.select("event_id", (F.col("event_id") % 6236 + 1).alias("place"))
    c = F.broadcast(seeds.chapters(spark))  # 114 rows
    return e.join(c, (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("verses"))).select("event_id", "chapter", (F.col("place") - F.col("first") + 1).alias("verse"))


@query(
    f"""with c as (select url, arg_max(html, page_id) as html, max(page_id) as fetched, count(*) as fetches from pages group by url)
 select url, fetched, fetches, {_DECODE.format("nullif(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '')")} as title, length(html) as size from c"""
)
def preview_store(spark, sf_dir):
    """A store of previews by address: the page fetched last replaces what was there."""
    from ..functions import text as fx
    from ..sources.sinks import upsert

    p = Tables(spark, sf_dir).pages
    last = p.groupBy("url").agg(F.max_by("html", "page_id").alias("html"), F.max("page_id").alias("fetched"), F.count("*").alias("fetches"))
    stored = last.where("fetched % 2 = 0").select("url", F.lit("stale").alias("html"), F.lit(-1).cast("bigint").alias("fetched"), F.lit(0).cast("bigint").alias("fetches"))
    rows = upsert(stored, last, "url")
    title = F.nullif(F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1), F.lit(""))
    return rows.select("url", "fetched", "fetches", fx.decode_entities(title).alias("title"), F.length("html").cast("bigint").alias("size"))


@query(
    """select 'documents' as part, doc_id as id, source as name from documents where doc_id = 7 union all select 'turns', turn, role from conversations where conv_id = 7 union all select 'labels', doc_id, 'quality ' || quality from labels where doc_id = 7"""
)
def record_bundle(spark, sf_dir):
    """One record with all that belongs to it: several result sets of one request, each a filtered scan."""
    t = Tables(spark, sf_dir)
    parts = {
        "documents": t.documents.where("doc_id = 7").select(F.col("doc_id").alias("id"), F.col("source").alias("name")),
        "turns": t.conversations.where("conv_id = 7").select(F.col("turn").alias("id"), F.col("role").alias("name")),
        "labels": t.labels.where("doc_id = 7").select(F.col("doc_id").alias("id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("name")),
    }
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), "id", "name")
        out = one if out is None else out.unionAll(one)
    return out
