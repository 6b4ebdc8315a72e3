"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k least distinct hashes of a text's word shingles. It is
a row's own work: no shuffle. Sketches of parts merge into that of the whole, and estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_position
from .session import cut, text_or_empty

SIZE, WIDTH = 128, 5


def bottom_k(text: Column, k: int = SIZE, width: int = WIDTH) -> Column:
    """The sketch of a text: words are runs without white space, lower-cased, `width` to a shingle.

    A text of fewer words has one shingle of all its words; one without words an empty sketch.
    """
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        long = F.transform(
            F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])
        )
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(h))).otherwise(long)

    # the one-element array binds the hashes to a variable, so that they are computed once
    return F.transform(F.array(hashes), lambda h: F.slice(F.sort_array(F.array_distinct(shingles(h))), 1, k))[0]


def merge(a: Column, b: Column, k: int = SIZE) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated Jaccard similarity: the share of the union's least hashes that both have. Two empty sketches: 1."""
    both = F.array_intersect(a, b)
    return F.transform(
        F.array(merge(a, b, k)),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, both)) / F.size(u)),
    )[0]


def distinct_shingles(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    spread = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / spread)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    """The hashes as 16 hexadecimal digits each, packed in base 64."""
    digits = F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def fingerprint(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """docs with `sketch`; a null text counts as empty."""
    return docs.withColumn("sketch", bottom_k(text_or_empty(docs), k, width))


def fingerprint_edits(docs: DataFrame, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the next document's beginning.

    The next document is that of the next greater doc_id, after the last that of the first.
    Where a doc_id repeats, the least text by hash stands for it. A row without doc_id has no next document: an empty text stands
    for it, so nothing follows its first three quarters. Null texts count as empty; two empty
    texts are alike (1), an empty one and another not (0). Other columns are ignored; an empty table gives no rows.

    Texts are shuffled once, by doc_id; each sends at most a quarter of its neighbour's length
    and its sketch to the document before it.
    """
    # the same filtered rows on both sides of the texts' joins, so that one shuffle serves both; an alias of
    # an unchanged column would make the two sides' plans differ
    plain = docs.schema["doc_id"].dataType.simpleString() == "bigint"
    doc_id = docs["doc_id"] if plain else docs["doc_id"].cast("long").alias("doc_id")
    every = docs.select(doc_id, text_or_empty(docs).alias("text"))
    base = every.where("doc_id is not null")
    ids = base.groupBy("doc_id").agg(
        F.floor(F.max(F.length("text")) / 4).cast("int").alias("need"), F.count("*").alias("rows")
    )
    placed = with_position(ids, "doc_id")
    total = placed.agg(F.count("*").alias("n"), F.coalesce(F.max("rows"), F.lit(1)).alias("most")).first()
    n = max(total["n"], 1)
    senders = (
        placed.select((F.col("position")).alias("p"), F.col("doc_id").alias("to"), "need")
        .join(placed.select(F.pmod(F.col("position") - 1, F.lit(n)).alias("p"), "doc_id"), "p")
        .drop("p")
    )
    sent = base.join(senders, "doc_id")
    if total["most"] > 1:
        least = Window.partitionBy("to").orderBy(F.xxhash64("text"), "text")
        sent = sent.withColumn("_r", F.row_number().over(least)).where("_r = 1")
    sent = sent.select(
        F.col("to").alias("_to"),
        F.substring(F.col("text"), F.lit(1), F.col("need")).alias("_begin"),
        bottom_k(F.col("text"), k, width).alias("_next"),
    )
    joined = base.join(sent, F.col("doc_id") == F.col("_to"), "left").drop("_to")
    joined = joined.unionByName(every.where("doc_id is null"), allowMissingColumns=True)
    size = F.length("text")
    cut_at = F.floor(size / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), size - cut_at),
        F.coalesce(F.substring(F.col("_begin"), F.lit(1), cut_at), F.lit("")),
    )
    rows = joined.select("doc_id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"), "_next")
    # both sketches are bound to one variable, so that what is said about them is said of one computation
    both = F.struct(bottom_k(F.col("text"), k, width).alias("own"), bottom_k(F.col("edited"), k, width).alias("new"))

    def facts(s: Column) -> Column:
        return F.struct(
            as_text(s["own"]).alias("fingerprint"),
            as_text(s["new"]).alias("edited_fingerprint"),
            resemblance(s["own"], s["new"], k).alias("near_edited"),
            resemblance(s["own"], F.coalesce("_next", F.array().cast("array<bigint>")), k).alias("near_next"),
            distinct_shingles(s["own"], k).alias("shingles"),
        )

    out = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        F.explode(F.transform(F.array(both), facts)).alias("f"),
    )
    return out.select("doc_id", "n_chars", "edited_sha256", "f.*")
