"""Alignment joins: cascading keys, prefixes, ordinals, backward and forward fills, page windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_windows
from . import scan
from .storage import materialize


def cascade_join(index: DataFrame, probe: DataFrame, sizes: Sequence[int] = (40, 30, 20, 15, 10)) -> DataFrame:
    """(probe_id, index_id, size, kind): each probe text's first hit over keys of falling size, end before middle.

    index, probe: (id, text). A key of the index belongs to the first id that has it, whichever
    kind of key it is there. All sizes go through one equi-join on (size, key).
    """
    keyed = lambda df, name: df.select(F.col("id").alias(name), F.explode(text_windows(F.col("text"), tuple(sizes))).alias("k")).select(name, "k.*")
    first = keyed(index, "index_id").groupBy("size", "key").agg(F.min("index_id").alias("index_id"))
    hits = keyed(probe, "probe_id").join(first, ["size", "key"])
    best = hits.groupBy("probe_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "kind", "index_id")).alias("m"))
    return best.select("probe_id", F.col("m.index_id").alias("index_id"), (-F.col("m.s")).alias("size"), F.col("m.kind").alias("kind"))


def prefix_key(name: Column, words: int) -> Column:
    """The first `words` words, null for a shorter name."""
    parts = F.split(name, " ")
    return F.when(F.size(parts) >= words, F.array_join(F.slice(parts, 1, words), " "))


def prefix_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, other, step): exact names, else four words with five to break ties, else three words if unambiguous.

    left, right: (id, name). Each step joins what the steps before left over. Names meet one row for each key, the
    least and the greatest id that have it, so names that very many rows share make no pairs.
    """
    left = materialize(left.select("id", "name"))
    named = materialize(right.select(F.col("id").alias("other"), "name"))

    def by_key(key: Column) -> DataFrame:
        return named.select("other", key.alias("_k")).where("_k is not null").groupBy("_k").agg(F.min("other").alias("low"), F.max("other").alias("high"))

    def by_prefix(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("_k", prefix_key(F.col("name"), n)).join(by_key(prefix_key(F.col("name"), n)), "_k")

    exact = left.withColumnRenamed("name", "_k").join(by_key(F.col("name")), "_k").groupBy("id").agg(F.min("low").alias("other"))
    exact = materialize(exact)
    rest = left.join(exact, "id", "left_anti")
    hits = by_prefix(rest, 5).select("id", F.lit(0).alias("f"), F.col("low").alias("other")).unionAll(by_prefix(rest, 4).select("id", F.lit(1), "low"))
    four = hits.groupBy("id").agg(F.min(F.struct("f", "other")).alias("m")).select("id", F.col("m.other").alias("other"))
    four = materialize(four)
    rest = rest.join(four, "id", "left_anti")
    three = by_prefix(rest, 3).groupBy("id").agg(F.min("low").alias("other"), F.max("high").alias("high")).where("other = high").drop("high")
    step = lambda df, s: df.select("id", "other", F.lit(s).alias("step"))
    return step(exact, "exact").unionAll(step(four, "four")).unionAll(step(three, "three"))


#: Numbers of a range that are listed together, and those that a task lists.
RANGE_BLOCK, RANGE_TASK = 4096, 1 << 20


def ordinal_zip(chapters: DataFrame, headings: DataFrame) -> DataFrame:
    """(number, page): the i-th chapter's numbers take the i-th heading's page; later chapters win.

    chapters: (grp, chapter, low, high); headings: (grp, page). Ordinals count inside grp. Ranges are cut at multiples
    of RANGE_BLOCK and dealt out before their numbers are listed, so that a long range is many tasks' work and
    the numbers themselves are never shuffled.
    """
    a = chapters.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("low", "chapter")))
    b = headings.withColumn("rn", F.row_number().over(Window.partitionBy("grp").orderBy("page")))
    met = a.join(b, ["grp", "rn"]).where("low <= high").select("grp", "rn", "page", "low", "high")
    block = lambda c: F.floor(F.col(c) / RANGE_BLOCK).cast("long")
    met = materialize(met.withColumns({"_first": block("low"), "_last": block("high")}))
    blocks = met.agg(F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1), F.lit(0))).first()[0]
    cut = met.select("grp", "rn", "page", "low", "high", F.explode(F.sequence("_first", "_last")).alias("_block"))
    begin = F.col("_block") * RANGE_BLOCK
    cut = cut.select("grp", "rn", "page", "_block", F.greatest("low", begin).alias("low"), F.least("high", begin + RANGE_BLOCK - 1).alias("high"))
    # all pieces of a block are in one partition, by a number of partitions that grows with the ranges
    dealt = cut.repartition(max(1, -(-blocks * RANGE_BLOCK // RANGE_TASK)), "grp", "_block")
    spread = dealt.select("grp", "_block", "rn", "page", F.explode(F.sequence("low", "high")).alias("number"))
    return spread.groupBy("grp", "_block", "number").agg(F.max_by("page", "rn").alias("page")).select("grp", "number", "page")


def fill_backward(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Each row's last value at or before it in its group; none before the first. A group may hold all rows."""
    return scan.fill(rows, group, [order], value, name)


def next_boundary(anchors: DataFrame, book: str, page: str, cap: int = 20) -> DataFrame:
    """Distinct (book, page) with stop: the next anchor's page in the book, at most `cap` further."""
    far = F.col(page) + cap
    ahead = scan.following(anchors.select(book, page).distinct(), book, page, "stop")
    return ahead.withColumn("stop", F.least(F.coalesce("stop", far), far)).where(F.col("stop") > F.col(page))


def pages_in_windows(windows: DataFrame, pages: DataFrame, book: str, page: str, cap: int = 20) -> DataFrame:
    """Pages in [page, stop) of the windows: an equi-join on book and a page bucket of width cap, then the range."""
    a = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(page) / cap), F.floor((F.col("stop") - 1) / cap))))
    b = pages.select(F.col(book).alias("_book"), F.col(page).alias("_page"), F.floor(F.col(page) / cap).alias("_c"))
    hit = (a[book] == b["_book"]) & (a["_b"] == b["_c"]) & (b["_page"] >= a[page]) & (b["_page"] < a["stop"])
    return a.join(b, hit).select(book, page, "stop", F.col("_page").alias("member"))


def inner_word(text: Column) -> Column:
    """The longest word of a text that isn't its first or last, so that any text which holds it has the word whole; null where there is none."""
    words = F.split(text, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.array_max(F.transform(F.filter(inner, lambda w: w != ""), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]


def words_of(texts: DataFrame, *keys: str) -> DataFrame:
    """Distinct words (keys, _w) of texts (keys, text)."""
    return texts.select(*keys, F.explode(F.array_distinct(F.split("text", " "))).alias("_w")).where("_w <> ''")


#: Longest runs of characters by which fragments meet words: anywhere in a word, and at its ends.
RUN, EDGE = 3, 4


def _runs(text: str, sizes: Sequence[int]) -> Column:
    """One row for each distinct run of characters of these sizes."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n)))).otherwise(F.array())
    return F.explode(F.array_distinct(F.concat(*[of(n) for n in sizes])))


def _inside_words(vocabulary: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragment, _w): words that hold the fragment; a fragment asks for its rarest run among the words' alone."""
    held = vocabulary.select(*keys, "_w", _runs("_w", range(1, RUN + 1)).alias("_k"))
    rarity = held.groupBy(*keys, "_k").agg(F.count("*").alias("_n"))
    size = F.least(F.length("fragment"), F.lit(RUN))
    own = fragments.select(*keys, "fragment", _runs("fragment", range(1, RUN + 1)).alias("_k")).where(F.length("_k") == size)
    best = own.join(rarity, [*keys, "_k"], "left").groupBy(*keys, "fragment").agg(F.min_by("_k", F.struct(F.coalesce("_n", F.lit(0)), "_k")).alias("_k"))
    return best.join(held, [*keys, "_k"]).where(F.contains("_w", "fragment")).select(*keys, "fragment", "_w")


def _at_ends(vocabulary: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragment, _w): words that end as the fragment begins, or begin as it ends, by the longer of both sides."""
    head, tail = F.substring_index("fragment", " ", 1), F.substring_index("fragment", " ", -1)
    first = F.length(head) >= F.length(tail)
    edge = lambda end, text: F.concat(F.lit("e" if end else "s"), F.right(text, F.least(F.length(text), F.lit(EDGE))) if end else F.left(text, F.least(F.length(text), F.lit(EDGE))))
    asked = fragments.withColumns({"_head": F.when(first, head), "_tail": F.when(~first, tail)}).withColumn("_k", F.coalesce(edge(True, F.col("_head")), edge(False, F.col("_tail"))))
    sides = [F.when(F.length("_w") >= n, F.concat(F.lit(kind), side(F.col("_w"), F.lit(n)))) for n in range(EDGE + 1) for kind, side in (("e", F.right), ("s", F.left))]
    held = vocabulary.select(*keys, "_w", F.explode(F.array_compact(F.array(*sides))).alias("_k"))
    met = asked.join(held, [*keys, "_k"])
    return met.where(F.coalesce(F.endswith("_w", "_head"), F.startswith("_w", "_tail"))).select(*keys, "fragment", "_w")


def short_hits(words: DataFrame, short: DataFrame, *group: str) -> DataFrame:
    """words ⋈ short: which fragments (group, fragment, ...) without an inner word a word may stand for.

    A fragment of one word stands inside a word of the text; of one with blanks the beginning ends a word, and the end begins one. Both
    meet the group's distinct words by equal runs of characters, so no fragment is compared with the whole vocabulary.
    """
    keys = list(group)
    vocabulary = materialize(words.select(*keys, "_w").distinct())
    fragments = short.select(*keys, "fragment").distinct()
    alone = F.instr("fragment", " ") == 0
    met = _inside_words(vocabulary, fragments.where(alone), keys).unionAll(_at_ends(vocabulary, fragments.where(~alone), keys))
    return words.join(short.join(met, [*keys, "fragment"]), [*keys, "_w"])


def containment_join(texts: DataFrame, probes: DataFrame, size: int = 80, skip: int = 20, least_bytes: int = 20) -> DataFrame:
    """(text_id, probe_id) where the text holds the probe's fragment: `size` characters after the first `skip`.

    texts: (grp, id, text); probes: (grp, id, text). Candidates meet in their group by the
    longest word inside the fragment, or, where it has none, by the words that its first can end; only those texts are compared.
    """
    p = probes.select("grp", F.col("id").alias("probe_id"), F.substring("text", skip + 1, size).alias("fragment"))
    p = p.where(F.octet_length("fragment") >= least_bytes)
    p = p.withColumn("_w", inner_word(F.col("fragment")))
    words = words_of(texts, "grp", "id")
    candidates = words.join(p.where("_w is not null"), ["grp", "_w"]).select("grp", "id", "probe_id", "fragment")
    short = short_hits(words, p.where("_w is null").drop("_w"), "grp").select("grp", "id", "probe_id", "fragment")
    both = candidates.unionAll(short).distinct()
    return both.join(texts, ["grp", "id"]).where(F.contains("text", "fragment")).select(F.col("id").alias("text_id"), "probe_id").distinct()


def gap_sessions(rows: DataFrame, key: str, order: str, gap: Column, name: str = "session") -> DataFrame:
    """rows numbered by runs: a new one starts where `gap` is true."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_g", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(name, F.sum("_g").over(w).cast("int")).drop("_g")


def merge_by_priority(parts: Sequence[tuple[str, DataFrame]], key: Sequence[str], value: str) -> DataFrame:
    """The value of the first part that has the key, and which part that was."""
    every = None
    for place, (name, df) in enumerate(parts):
        one = df.select(*key, F.struct(F.lit(place).alias("p"), F.lit(name).alias("origin"), F.col(value).alias("v")).alias("s"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy(*key).agg(F.min("s").alias("s")).select(*key, F.col("s.v").alias(value), F.col("s.origin").alias("origin"))


def compare_chains(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per key: whether two chains of names have one length and each name of one holds or is held by the other's."""
    rows = left.select(key, F.col("chain").alias("a")).join(right.select(key, F.col("chain").alias("b")), key)
    alike = F.zip_with("a", "b", lambda x, y: F.contains(x, y) | F.contains(y, x))
    return rows.select(key, (F.size("a") == F.size("b")).alias("same_length"), ((F.size("a") == F.size("b")) & F.forall(alike, lambda v: F.coalesce(v, F.lit(False)))).alias("same"))
