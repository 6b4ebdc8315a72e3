"""Registered queries over indexed fields and their fusion, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import overlap, search, vector_index
from ..operators.storage import fresh_path
from ..sources.fixtures import Tables
from .search_queries import COSINE, KNN_SQL, RRF, TERMS, TOKEN, _bm25, _bm25_sql, _knn

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The question of these queries, and for each word a pattern of the words that share its stem.
QUESTION = ("thing", "the")
STEMMED = {"thing": "thing(s|es|ed|ing|ly|edly|ingly|lyed|lying)?", "the": "the"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _field_sql(name: str, tokens: str, match: dict[str, str]) -> str:
    """Ranked BM25 of documents whose token lists `tokens` hold a token of every pattern."""
    listed = ", ".join(f"('{t}', '^({p})$')" for t, p in match.items())
    return f"""{name}_t as (select doc_id as id, {tokens} as ts from documents where text is not null), {name}_st as (select count(*) as n, avg(len(ts)) as avgdl from {name}_t),
 {name}_tf as (select id, term, len(ts) as dl, len(list_filter(ts, lambda x: regexp_matches(x, p))) as tf from {name}_t, (values {listed}) as q(term, p)),
 {name}_df as (select term, count(*) filter (where tf > 0) as df from {name}_tf group by term),
 {name} as (select id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from {name}_tf join {name}_df using (term), {name}_st where tf > 0 group by id having count(*) = {len(match)}),
 {name}_r as (select id, round(score, 9) as score, row_number() over (order by round(score, 9) desc, id) as rank from {name})"""


_EN = f"regexp_extract_all(lower(text), '{TOKEN}')"
_RAW = f"regexp_extract_all(text, '{TOKEN}')"
_LEMMA = f"list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: substr(x, 1, 5))"
_PLAIN = {w: w for w in QUESTION}


def _index(t: Tables, name: str) -> str:
    """The path of an index over the documents: stemmed English, plain, or a lemma (a word's first five letters)."""
    d = t.documents.select("doc_id", "text")
    if name == "lemma":
        d = d.withColumn("text", F.array_join(F.transform(fx.tokenize(F.col("text")), lambda x: F.substring(x, 1, 5)), " "))
    path = fresh_path(t.spark, f"index-{name}")
    search.write_index(d, "doc_id", "text", path, **({"lower": True, "stem": True} if name == "en" else {}))
    return path


def _ranked(t: Tables, path: str, terms, limit: int = 20):
    scores = search.search_index(t.spark, path, terms)
    return search.ranked(scores.withColumn("score", F.round("score", 9)), limit)


def _lists(t: Tables, *names: str):
    return [_ranked(t, _index(t, n), search.stems(QUESTION) if n == "en" else QUESTION) for n in names]


@query(f"with {_bm25_sql(TERMS, True)} select id as doc_id, cast(rank as int) as rank, round(score, 6) as score from b_r where rank <= 20")
def bm25_indexed(spark, sf_dir):
    """Full text from a stored index: the query reads its terms' postings alone."""
    t = Tables(spark, sf_dir)
    path = fresh_path(spark, "index")
    search.write_index(t.documents, "doc_id", "text", path)
    return _ranked(t, path, TERMS).select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(f"with {_field_sql('e', _EN, STEMMED)} select id as doc_id, cast(rank as int) as rank, round(score, 6) as score from e_r where rank <= 20")
def bm25_en_stem(spark, sf_dir):
    """BM25 over the stemmed analyzer: any form of a word finds any other."""
    return _lists(Tables(spark, sf_dir), "en")[0].select(F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _fused(parts: str, *lists: str) -> str:
    union = " union all ".join(f"select id, rank from {x} where rank <= 20" for x in lists)
    return f"with {parts}, f as ({RRF.format(union)}), g as (select * from f order by score desc, id limit 20) select doc_id, round(score, 6) as score, lang, source from g join documents on id = doc_id"


def _found(t: Tables, lists):
    best = search.fuse(lists, 20)
    rows = best.join(t.documents.select("doc_id", "lang", "source"), F.col("id") == F.col("doc_id"))
    return rows.select("doc_id", F.round("score", 6).alias("score"), "lang", "source")


_E, _P, _L = _field_sql("e", _EN, STEMMED), _field_sql("p", _RAW, _PLAIN), _field_sql("l", _LEMMA, _PLAIN)


@query(_fused(f"{_E}, {_P}", "e_r", "p_r"))
def search_text(spark, sf_dir):
    """Stemmed and plain field fused by rank."""
    t = Tables(spark, sf_dir)
    return _found(t, _lists(t, "en", "plain"))


@query(_fused(f"{KNN_SQL}, {_E}, {_P}", "k_r", "e_r", "p_r"))
def search_hybrid(spark, sf_dir):
    """Vectors, stemmed and plain field: three lists fused."""
    t = Tables(spark, sf_dir)
    return _found(t, [_knn(t, 20), *_lists(t, "en", "plain")])


@query(_fused(f"{_E}, {_P}, {_L}", "e_r", "p_r", "l_r"))
def verse_search(spark, sf_dir):
    """Stemmed, plain and lemma field: three lists fused."""
    t = Tables(spark, sf_dir)
    return _found(t, _lists(t, "en", "plain", "lemma"))


@query(_fused(f"{KNN_SQL}, {_E}, {_P}, {_L}", "k_r", "e_r", "p_r", "l_r"))
def verse_hybrid(spark, sf_dir):
    """Vectors and three fields: four lists fused."""
    t = Tables(spark, sf_dir)
    return _found(t, [_knn(t, 20), *_lists(t, "en", "plain", "lemma")])


@query(
    f"""with {_bm25_sql(TERMS, True, 'x')}, {KNN_SQL}, u as (select 'documents' as source, 0 as place, id, rank from x_r where rank <= 21 union all select 'vectors', 1, id, rank from k_r where rank <= 21),
 c as (select source, count(*) as total from u group by source)
 select source, cast(id as varchar) as id, cast(rank as int) as rank, round(1.0::double / (60 + rank), 6) as score, total from u join c using (source) order by 1.0::double / (60 + u.rank) desc, place, u.rank limit 10 offset 10"""
)
def unified_totals(spark, sf_dir):
    """The second page of ten over two sources, with the number of rows each source gave."""
    t = Tables(spark, sf_dir)
    page = search.page_with_totals([("documents", _bm25(t, TERMS, limit=21)), ("vectors", _knn(t, 21))], 2, 10)
    return page.select("source", "id", "rank", F.round("score", 6).alias("score"), "total")


@query(f"with {KNN_SQL} select id as vec_id, cast(rank as int) as rank, round(score, 6) as score from k_r where rank <= 10")
def knn_indexed(spark, sf_dir):
    """The ten nearest of a stored vector from an index of lists: few are read, and none that could hold a nearer one is left out."""
    t = Tables(spark, sf_dir)
    path = fresh_path(spark, "vectors")
    vector_index.write_vector_index(t.embeddings, "vec_id", "embedding", path)
    row = t.embeddings.where("vec_id = 0").select("embedding").first()
    near = vector_index.nearest(spark, path, row[0], 10) if row else t.embeddings.limit(0).select(F.col("vec_id").alias("id"), F.lit(0.0).alias("score"))
    return search.ranked(near, 10).select(F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(
    """select doc_id, md5('passage: ' || array_to_string(list_filter([trim(lang), trim(source), trim(text)], lambda x: x <> ''), chr(10))) as passage, md5('query: ' || trim(text)) as question from documents"""
)
def embedding_texts(spark, sf_dir):
    """What a model is given for each document and question, by checksum."""
    d = Tables(spark, sf_dir).documents
    made = search.passage(F.col("lang"), F.col("source"), F.col("text"))
    asked = search.passage(F.col("text"), prefix="query: ")
    return d.select("doc_id", F.md5(made.cast("binary")).alias("passage"), F.md5(asked.cast("binary")).alias("question"))


@query(
    """with e as (select distinct l_orderkey as a, l_partkey % 500 + 1 as b from lineitem where l_returnflag = 'R')
 select b as item, count(*) as curated, list(a order by a)[1:25] as neighbours, max(o_totalprice) as top_price from e join orders on o_orderkey = a group by b"""
)
def curated_neighbours(spark, sf_dir):
    """Each item's neighbours over stored edges, 25 of them, with the number and an attribute of all."""
    t = Tables(spark, sf_dir)
    edges = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") % 500 + 1).alias("b")).distinct()
    rows = edges.join(t.orders.select(F.col("o_orderkey").alias("a"), "o_totalprice"), "a")
    return rows.groupBy(F.col("b").alias("item")).agg(
        F.count("*").alias("curated"), F.slice(F.sort_array(F.collect_list("a")), 1, 25).alias("neighbours"), F.max("o_totalprice").alias("top_price")
    )


_PHRASES = "phrase as (select conv_id, turn, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 6))) as phrase from conversations)"


@query(
    f"""with {_PHRASES}, p as (select a.conv_id, a.turn, b.conv_id as other_conv, b.turn as other_turn, a.phrase from phrase a join phrase b on a.phrase = b.phrase and (a.conv_id, a.turn) <> (b.conv_id, b.turn)),
 s as (select conv_id, turn, other_conv, other_turn, count(*) as shared, min(phrase) as phrase from p group by all),
 r as (select *, row_number() over (partition by conv_id, turn order by shared desc, other_conv, other_turn) as rank from s)
 select conv_id, turn, other_conv, other_turn, shared, phrase, cast(rank as int) as rank from r where rank <= 5"""
)
def shared_phrases(spark, sf_dir):
    """The five turns that share most of a turn's phrases with it, and the first shared phrase."""
    c = Tables(spark, sf_dir).conversations
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 6))
    rows = c.select(F.struct("conv_id", "turn").alias("id"), F.explode(words).alias("element"))
    return overlap.top_overlaps(rows, 5).select("id.*", F.col("other.conv_id").alias("other_conv"), F.col("other.turn").alias("other_turn"), "shared", F.col("least").alias("phrase"), "rank")


@query(
    f"""with {_PHRASES} select phrase, count(*) as places, count(distinct conv_id) as conversations, min(conv_id) as first_conversation, list(conv_id * 1000 + turn order by conv_id, turn)[1:10] as first_places from phrase group by phrase having count(*) >= 2"""
)
def phrase_detail(spark, sf_dir):
    """Each repeated phrase: where it stands, the first ten places."""
    c = Tables(spark, sf_dir).conversations
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 6))
    rows = c.select("conv_id", "turn", F.explode(words).alias("phrase"))
    place = F.col("conv_id") * 1000 + F.col("turn")
    return rows.groupBy("phrase").agg(
        F.count("*").alias("places"), F.count_distinct("conv_id").alias("conversations"), F.min("conv_id").alias("first_conversation"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("conv_id", "turn", place.alias("p")))), 1, 10), lambda x: x["p"]).alias("first_places"),
    ).where("places >= 2")


assert COSINE in KNN_SQL
