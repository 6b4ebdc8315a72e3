"""Full-text search, vector search and rank fusion.

A field is tokenised once, either to an index of postings in a folder, of which a query reads the
partitions of its terms, or for one query to the counts of its terms in each document.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rrf_term, tokenize
from .near import neighbours  # noqa: F401  (part of the search interface)
from .storage import materialize

K1, B = 1.2, 0.75
#: Columns of blocks of postings, and words whose stems a task remembers.
BLOCK, STEMS = ["token", "ids", "tfs", "dls", "docs", "words"], 1 << 18


def posting_blocks(docs: DataFrame, key: str, text: str, lower: bool = False, stem: bool = False) -> DataFrame:
    """(token, ids, tfs, dls, docs, words): postings by blocks, one row for each token of some thousand documents.

    ids: the documents that hold the token; tfs: how often; dls: their lengths. Rows without a token tell the documents and words of a
    block. Words are counted where their documents are read, so that nothing is shuffled. stem: by the English stemmer, once a task for a word.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.stemmer import stem as stem_of

        known = functools.lru_cache(STEMS)(stem_of)
        for b in batches:
            ids, lists, n = b.column("id"), b.column("tokens"), b.num_rows
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            told = lists.flatten().dictionary_encode()
            tokens, code = told.dictionary, told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if stem:
                tokens = pa.array(map(known, tokens.to_pylist()), pa.string()).dictionary_encode()
                tokens, code = tokens.dictionary, tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
            pair, tf = np.unique(code * n + np.repeat(np.arange(n), lengths), return_counts=True)
            code, doc = np.divmod(pair, max(n, 1))
            named = ids.is_valid().to_numpy(zero_copy_only=False)[doc]  # documents without an id count, and are not found
            code, doc, tf = code[named], doc[named], tf[named]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            ends = pa.array(np.append(first, len(code)), pa.int32())
            listed = lambda values, ends=ends: pa.ListArray.from_arrays(ends, values)
            columns = [listed(ids.take(pa.array(doc))), listed(pa.array(tf, pa.int32())), listed(pa.array(lengths[doc], pa.int32()))]
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([tokens.take(pa.array(code[first])), *columns, none, none], names=BLOCK)
            sums = [pa.array([int(x)], pa.int64()) for x in (n, lengths.sum())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), *(pa.nulls(1, c.type) for c in columns), *sums], names=BLOCK)

    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokenize(F.col(text), lower).alias("tokens"))
    return rows.mapInArrow(run, f"token string, ids array<{kind}>, tfs array<int>, dls array<int>, docs bigint, words bigint")


def write_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = 64, **analyzer) -> None:
    """An index of a text field under path: blocks of postings in folders by a hash of the token, and one row of statistics.

    Each task writes the blocks of the documents that it read, so a frequent token's postings are in as many files as there are tasks.
    """
    bucket = F.when(F.col("token").isNull(), -1).otherwise(token_bucket(F.col("token"), buckets))  # -1: the sums of blocks
    rows = posting_blocks(docs, key, text, **analyzer).withColumn("bucket", bucket)
    rows.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings")
    sums = docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/postings").where("bucket = -1")
    n, words = F.coalesce(F.sum("docs"), F.lit(0)), F.sum("words")
    sums.agg(n.alias("n"), (words / n).alias("avgdl"), F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}/statistics")


def token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def search_index(spark, path: str, terms: Sequence[str], conjunctive: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of BM25 from an index: only the partitions and row groups of the terms are read."""
    wanted = list(dict.fromkeys(terms))
    statistics = spark.read.parquet(f"{path}/statistics").first()
    # the buckets are worked out as literals, so that folders are pruned before anything is read
    asked = spark.range(1).select(*[token_bucket(F.lit(w), statistics["buckets"]) for w in wanted]).first()
    blocks = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(*asked) & F.col("token").isin(*wanted))
    hits = blocks.select("token", F.inline(F.arrays_zip("ids", "tfs", "dls")).alias("id", "tf", "dl"))
    return bm25_of(hits, statistics["n"], statistics["avgdl"], wanted, conjunctive, k1, b)


def bm25_of(hits: DataFrame, n: int, avgdl: float, wanted: Sequence[str], conjunctive: bool, k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) from the postings (token, id, tf, dl) of the wanted terms."""
    df = hits.groupBy("token").agg(F.count("*").alias("df"))  # one row for each term
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf")
    term = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    scores = hits.join(F.broadcast(df), "token").groupBy("id").agg(F.sum(term).alias("score"), F.count("*").alias("have"))
    return (scores.where(F.col("have") == len(wanted)) if conjunctive else scores).select("id", "score")


def stems(words: Sequence[str]) -> list[str]:
    """Terms of a query for a stemmed field."""
    from ..functions.stemmer import stem

    return [stem(w.lower()) for w in words]


def bm25(
    docs: DataFrame, key: str, text: str, terms: Sequence[str], conjunctive: bool = True, k1: float = K1, b: float = B, lower: bool = False
) -> DataFrame:
    """(id, score) of the documents that hold all terms (or any), without an index.

    One pass over the text keeps each document's length and its counts of the query's terms;
    statistics and scores come from those.
    """
    wanted = list(dict.fromkeys(terms))
    tokens = tokenize(F.col(text), lower)
    base = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens.alias("_t"))

    def occurrences(word: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == F.lit(word)))

    base = materialize(base.select("id", F.size("_t").alias("dl"), *[occurrences(w).alias(f"tf{i}") for i, w in enumerate(wanted)]))
    sums = [F.count("*").alias("n"), F.avg("dl").alias("avgdl")]
    sums += [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]
    rows = base.crossJoin(F.broadcast(base.agg(*sums)))
    score, have = F.lit(0.0), F.lit(0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
        have = have + (tf > 0).cast("int")
    return rows.where(have == len(wanted) if conjunctive else have > 0).select("id", score.alias("score"))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """The best `limit` rows with rank, ties by id. The ordered limit comes first, so the window sees `limit` rows."""
    best = scores.orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two double arrays; null for a zero or null vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def knn(vectors: DataFrame, key: str, vector: str, query: Sequence[float]) -> DataFrame:
    """(id, score): exact similarity of every vector to one query vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(F.col(key).alias("id"), cosine(as_double(F.col(vector)), q).alias("score")).where("score is not null")


def fuse(lists: Sequence[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank, ...): (id, score), the best `limit`, ties by id."""
    every = lists[0].select("id", "rank")
    for x in lists[1:]:
        every = every.unionAll(x.select("id", "rank"))
    # terms are added in a fixed order, so equal sets of ranks give equal sums
    total = F.aggregate(F.array_sort(F.collect_list(rrf_term(F.col("rank"), k))), F.lit(0.0), lambda a, x: a + x)
    return every.groupBy("id").agg(total.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def unified_page(sources: Sequence[tuple[str, DataFrame]], page: int, limit: int, k: int = 60) -> DataFrame:
    """One page over ranked lists of several sources: score 1 / (k + rank in source), ties by source order then rank."""
    every = None
    for place, (name, rows) in enumerate(sources):
        part = rows.where(F.col("rank") <= page * limit + 1).select(
            F.lit(name).alias("source"), F.lit(place).alias("_place"), F.col("id").cast("string").alias("id"), "rank", rrf_term(F.col("rank"), k).alias("score")
        )
        every = part if every is None else every.unionAll(part)
    return every.orderBy(F.desc("score"), "_place", "rank").offset((page - 1) * limit).limit(limit).select("source", "id", "rank", "score")


def page_with_totals(sources: Sequence[tuple[str, DataFrame]], page: int, limit: int, k: int = 60) -> DataFrame:
    """unified_page with `total`, how many rows each source has."""
    rows = unified_page(sources, page, limit, k)
    totals = None
    for name, df in sources:
        one = df.agg(F.count("*").alias("total")).select(F.lit(name).alias("source"), "total")
        totals = one if totals is None else totals.unionAll(one)
    return rows.join(F.broadcast(totals), "source")  # one row for each source


def passage(*parts: Column, prefix: str = "passage: ") -> Column:
    """The text that is embedded for a row: its non-empty parts in order, one to a line, behind the model's prefix."""
    some = F.filter(F.array(*[F.trim(p.cast("string")) for p in parts]), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.concat(F.lit(prefix), F.array_join(some, "\n"))


def embed_with(model, texts: DataFrame, key: str, text: str, batch: int = 64, prefix: str = "passage: ") -> DataFrame:
    """(key, embedding) by an injected model, a picklable function from a list of texts to vectors."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), batch):
                out += [list(map(float, v)) for v in model([prefix + (x or "") for x in f[text].iloc[at : at + batch]])]
            yield pd.DataFrame({key: f[key], "embedding": out})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
