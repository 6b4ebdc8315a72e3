"""Registered retrieval queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import search
from ..sources.fixtures import Tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

TERMS = ("the", "of")
RARE = ("that", "Is")
TOKEN = r"(\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(terms, conjunctive: bool, name: str = "b") -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    have = f"having count(*) = {len(terms)}" if conjunctive else ""
    return f"""{name}_tok as (select doc_id as id, unnest(regexp_extract_all(text, '{TOKEN}')) as token from documents where text is not null),
 {name}_len as (select doc_id as id, len(regexp_extract_all(text, '{TOKEN}')) as dl from documents where text is not null),
 {name}_st as (select count(*) as n, avg(dl) as avgdl from {name}_len),
 {name}_tf as (select token, id, count(*) as tf from {name}_tok where token in (select * from (values {listed})) group by all),
 {name}_df as (select token, count(*) as df from {name}_tf group by token),
 {name} as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
 from {name}_tf join {name}_df using (token) join {name}_len using (id), {name}_st group by id {have}),
 {name}_r as (select id, round(score, 9) as score, row_number() over (order by round(score, 9) desc, id) as rank from {name})"""


def _bm25(t: Tables, terms, conjunctive=True, limit=20):
    scores = search.bm25(t.documents, "doc_id", "text", terms, conjunctive)
    return search.ranked(scores.withColumn("score", F.round("score", 9)), limit)


@query(f"with {_bm25_sql(TERMS, True)} select id as doc_id, cast(rank as int) as rank, round(score, 6) as score, lang, source from b_r join documents on id = doc_id where rank <= 20")
def bm25_topk_ar(spark, sf_dir):
    """Unstemmed full-text search, all terms required, joined back to its rows."""
    t = Tables(spark, sf_dir)
    top = _bm25(t, TERMS)
    rows = top.join(t.documents.select("doc_id", "lang", "source"), F.col("id") == F.col("doc_id"))
    return rows.select("doc_id", "rank", F.round("score", 6).alias("score"), "lang", "source")


@query(f"with {_bm25_sql(RARE, False)} select id as doc_id, cast(rank as int) as rank, round(score, 6) as score from b_r where rank <= 20")
def bm25_topk_or(spark, sf_dir):
    return _bm25(Tables(spark, sf_dir), RARE, conjunctive=False).select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


COSINE = "list_dot_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))"
KNN_SQL = f"k_r as (select e.vec_id as id, round({COSINE}, 9) as score, row_number() over (order by round({COSINE}, 9) desc, e.vec_id) as rank from embeddings e, embeddings q where q.vec_id = 0)"


def _knn(t: Tables, limit: int, vec_id: int = 0):
    """Neighbours of one stored vector, read first as a single row."""
    row = t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").first()
    if row is None:
        return search.ranked(t.embeddings.limit(0).select(F.col("vec_id").alias("id"), F.lit(0.0).alias("score")), limit)
    return search.ranked(search.knn(t.embeddings, "vec_id", "embedding", row[0]).withColumn("score", F.round("score", 9)), limit)


@query(f"with {KNN_SQL} select id as vec_id, cast(rank as int) as rank, round(score, 6) as score from k_r where rank <= 10")
def knn_topk(spark, sf_dir):
    return _knn(Tables(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


SELF_SQL = f"""s as (select q.vec_id as id, e.vec_id as other, {COSINE} as score from embeddings e, embeddings q),
 s_r as (select *, row_number() over (partition by id order by round(score, 12) desc, other) as rank from s)"""


@query(f"with {SELF_SQL} select id, other, cast(rank as int) as rank, round(score, 6) as score from s_r where rank <= 5")
def knn_self_neighbours(spark, sf_dir):
    """The five nearest of every vector, by blocks of matrix products."""
    rows = search.neighbours(Tables(spark, sf_dir).embeddings, "vec_id", "embedding", 5)
    return rows.select("id", "other", "rank", F.round("score", 6).alias("score"))


RRF = "select id, round(sum(1.0::double / (60 + rank)), 9) as score from ({}) group by id"


@query(
    f"with {_bm25_sql(TERMS, True, 'x')}, {_bm25_sql(RARE, False, 'y')}, f as ({RRF.format('select id, rank from x_r where rank <= 20 union all select id, rank from y_r where rank <= 20')}) "
    "select id as doc_id, round(score, 6) as score from f order by f.score desc, id limit 20"
)
def rrf_two_lists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = search.fuse([_bm25(t, TERMS), _bm25(t, RARE, False)], 20)
    return both.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    f"with {_bm25_sql(TERMS, True, 'x')}, {KNN_SQL}, f as ({RRF.format('select id, rank from x_r where rank <= 20 union all select id, rank from k_r where rank <= 20')}), "
    "g as (select * from f order by score desc, id limit 20) select doc_id, round(score, 6) as score, lang, source from g join documents on id = doc_id"
)
def hybrid_search(spark, sf_dir):
    """Full text and vectors fused by rank, the best twenty joined to their documents."""
    t = Tables(spark, sf_dir)
    best = search.fuse([_bm25(t, TERMS), _knn(t, 20)], 20)
    rows = best.join(t.documents.select("doc_id", "lang", "source"), F.col("id") == F.col("doc_id"))
    return rows.select("doc_id", F.round("score", 6).alias("score"), "lang", "source")


@query(
    f"""with {_bm25_sql(TERMS, True, 'x')}, {KNN_SQL}, u as (select 'documents' as source, 0 as place, id, rank from x_r where rank <= 21 union all select 'vectors', 1, id, rank from k_r where rank <= 21)
 select source, cast(id as varchar) as id, cast(rank as int) as rank, round(1.0::double / (60 + rank), 6) as score from u order by 1.0::double / (60 + u.rank) desc, place, u.rank limit 10 offset 10"""
)
def unified_page(spark, sf_dir):
    """The second page of ten over two sources."""
    t = Tables(spark, sf_dir)
    page = search.unified_page([("documents", _bm25(t, TERMS, limit=21)), ("vectors", _knn(t, 21))], 2, 10)
    return page.withColumn("score", F.round("score", 6))


@query("select s_suppkey, s_name from supplier where contains(lower(s_name), '00001') order by s_suppkey limit 20")
def substring_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.supplier.where(F.contains(F.lower("s_name"), F.lit("00001"))).select("s_suppkey", "s_name").orderBy("s_suppkey").limit(20)


@query(
    """with h as (select c_custkey, c_name, (c_name = 'Customer#000000042')::int * 4 + (contains(lower(c_name), '42'))::int * 2 + (c_nationkey = 4)::int as signal from customer)
 select c_custkey, c_name, signal from h where signal > 0 order by signal desc, c_custkey limit 25"""
)
def multi_signal_resolve(spark, sf_dir):
    """Customers that any of several signals matches, the strongest first."""
    t = Tables(spark, sf_dir)
    signals = [(F.col("c_name") == "Customer#000000042", 4), (F.contains(F.lower("c_name"), F.lit("42")), 2), (F.col("c_nationkey") == 4, 1)]
    total = sum((F.coalesce(s, F.lit(False)).cast("int") * w for s, w in signals[1:]), F.coalesce(signals[0][0], F.lit(False)).cast("int") * signals[0][1])
    return t.customer.select("c_custkey", "c_name", total.alias("signal")).where("signal > 0").orderBy(F.desc("signal"), "c_custkey").limit(25)


@query("select event_id, list_contains([event_type, 'u' || user_id], 'u7') as tagged from events where list_contains([event_type, 'u' || user_id], 'u7')")
def tag_membership(spark, sf_dir):
    t = Tables(spark, sf_dir)
    tags = F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return t.events.select("event_id", F.array_contains(tags, "u7").alias("tagged")).where("tagged")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice > 1000 order by o_orderkey limit 50 offset 100")
def paged_list(spark, sf_dir):
    """Conjunction of the predicates that were given, then a page."""
    t = Tables(spark, sf_dir)
    given = {"o_orderstatus": F.col("o_orderstatus") == "O", "o_totalprice": F.col("o_totalprice") > 1000, "o_custkey": None}
    rows = t.orders
    for p in given.values():
        rows = rows if p is None else rows.where(p)
    return rows.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(100).limit(50)


@query(
    """select 20 as page_size, count(*) as total, count(*) >= 40 as full_page, count(*) > 40 as probe, (select count(*) from (select * from supplier order by s_suppkey limit 21 offset 20)) > 20 as limit_plus_one from supplier"""
)
def has_more_probe(spark, sf_dir):
    """Three ways to tell whether more follows the second page of twenty."""
    t = Tables(spark, sf_dir)
    window = t.supplier.orderBy("s_suppkey").offset(20).limit(21).agg((F.count("*") > 20).alias("limit_plus_one"))
    total = t.supplier.agg(F.count("*").alias("total"))
    return total.crossJoin(window).select(
        F.lit(20).alias("page_size"), "total", (F.col("total") >= 40).alias("full_page"), (F.col("total") > 40).alias("probe"), "limit_plus_one"
    )


@query(
    f"""with {SELF_SQL}, n as (select s_r.id, other, row_number() over (partition by s_r.id order by rank) as rank, score from s_r where s_r.id <> other),
 j as (select n.*, a.label = b.label as hit from n join embeddings a on a.vec_id = n.id join embeddings b on b.vec_id = other where rank <= 5),
 q as (select id, coalesce(1.0::double / min(case when hit then rank end), 0) as rr, max(case when hit and rank <= 1 then 1.0::double else 0 end) as r1, max(case when hit and rank <= 3 then 1.0::double else 0 end) as r3,
 max(case when hit then 1.0::double else 0 end) as r5, stddev_pop(score) as spread, max(score) - min(score) as gap from j group by id)
 select round(avg(rr), 6) as mrr, round(avg(r1), 6) as recall_1, round(avg(r3), 6) as recall_3, round(avg(r5), 6) as recall_5, round(avg(spread), 6) as spread, round(avg(gap), 6) as gap from q"""
)
def ir_metrics(spark, sf_dir):
    """Ranking quality of nearest neighbours with equal labels as relevance."""
    t = Tables(spark, sf_dir)
    rows = search.neighbours(t.embeddings, "vec_id", "embedding", 6).where("id <> other")
    from pyspark.sql import Window

    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("rank <= 5")
    label = t.embeddings.select("vec_id", "label")
    rows = rows.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("a")), "id").join(label.select(F.col("vec_id").alias("other"), F.col("label").alias("b")), "other")
    hit = F.col("a") == F.col("b")
    at = lambda n: F.max(F.when(hit & (F.col("rank") <= n), 1.0).otherwise(0.0))
    per = rows.groupBy("id").agg(
        F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), at(1).alias("r1"), at(3).alias("r3"), at(5).alias("r5"),
        F.stddev_pop("score").alias("spread"), (F.max("score") - F.min("score")).alias("gap"),
    )
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return per.agg(mean("rr", "mrr"), mean("r1", "recall_1"), mean("r3", "recall_3"), mean("r5", "recall_5"), mean("spread", "spread"), mean("gap", "gap"))


@query(
    f"""with {SELF_SQL}, n as (select s_r.id, other, row_number() over (partition by s_r.id order by rank) as rank, score from s_r where s_r.id <> other),
 j as (select n.*, a.label % 5 as category, a.label = b.label as hit from n join embeddings a on a.vec_id = n.id join embeddings b on b.vec_id = other where rank <= 5),
 q as (select category, id, coalesce(1.0::double / min(case when hit then rank end), 0) as rr, max(case when hit then 1.0::double else 0 end) as r5 from j group by category, id)
 select category, count(*) as questions, round(avg(rr), 6) as mrr, round(avg(r5), 6) as recall_5 from q group by category"""
)
def ir_metrics_by_category(spark, sf_dir):
    """Ranking quality of nearest neighbours in each category of questions."""
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    rows = search.neighbours(t.embeddings, "vec_id", "embedding", 6).where("id <> other")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("rank"))).where("rank <= 5")
    label = t.embeddings.select("vec_id", "label")
    rows = rows.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("a")), "id").join(label.select(F.col("vec_id").alias("other"), F.col("label").alias("b")), "other")
    hit = F.col("a") == F.col("b")
    per = rows.groupBy((F.col("a") % 5).alias("category"), "id").agg(
        F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.max(F.when(hit, 1.0).otherwise(0.0)).alias("r5")
    )
    return per.groupBy("category").agg(F.count("*").alias("questions"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("r5"), 6).alias("recall_5"))


@query(
    f"""with {SELF_SQL}, e as (select least(id, other) as a, greatest(id, other) as b from s_r join embeddings x on x.vec_id = id join embeddings y on y.vec_id = other
 where rank <= 10 and id <> other and score >= 0.30 and x.label = y.label group by all),
 edges as (select a, b from e union select b, a from e)
 , reach as (select a as node, b as other from edges union select r.node, x.b from reach r join edges x on r.other = x.a)
 select node, least(node, min(other)) as family, cast(count(distinct other) as bigint) as members from reach group by node""".replace("with s as", "with recursive s as")
)
def families(spark, sf_dir):
    """Components of similar vectors that share a label: in each other's ten nearest, cosine of at least 0.30."""
    from ..operators import graph

    t = Tables(spark, sf_dir)
    near = search.neighbours(t.embeddings, "vec_id", "embedding", 10).where("id <> other and score >= 0.30")
    label = t.embeddings.select("vec_id", "label")
    rows = near.join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("x")), "id").join(label.select(F.col("vec_id").alias("other"), F.col("label").alias("y")), "other")
    parts = graph.connected_components(rows.where("x = y").select(F.col("id").alias("a"), F.col("other").alias("b")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
    return parts.join(sizes, "component").select("node", F.col("component").alias("family"), "members")


@query("select event_id, 1.0::double / (60 + k) as term, least(greatest((value - 10) / 40.0, 0.0), 1.0)::double as scaled from (select *, cast(json_extract(props, '$.k') as bigint) as k from events)".replace("1.0::double / (60 + k)", "round(1.0::double / (60 + k), 6)").replace("least(greatest((value - 10) / 40.0, 0.0), 1.0)::double", "round(least(greatest((value - 10) / 40.0, 0.0), 1.0)::double, 6)"))
def score_terms(spark, sf_dir):
    """Rank terms and clamped scaling, from a number inside a JSON column."""
    t = Tables(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select("event_id", F.round(fx.rrf_term(k), 6).alias("term"), F.round(fx.clamp_scale(F.col("value"), 10.0, 50.0), 6).alias("scaled"))
