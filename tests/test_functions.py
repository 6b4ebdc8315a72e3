"""Scalar functions, the stemmer, the diff and the walks on cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.functions.stemmer import stem
from tessera.operators import align, context, diff, graph, search, tree, verify


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_kinship_forms(spark):
    name = lambda s: value(spark, fx.normalize_name(F.col("t")), t=s)
    assert name("ابي هريره") == "ابو هريره"
    assert name("ابي") == "ابي"
    assert value(spark, fx.resolve_relative(F.col("w"), F.col("r")), w="ابيه", r="هشام بن عروه") == "عروه"
    assert value(spark, fx.resolve_relative(F.col("w"), F.col("r")), w="ابيه", r="جابر") == "ابو جابر"
    assert value(spark, fx.resolve_relative(F.col("w"), F.col("r")), w="x", r="جابر") is None


@pytest.mark.parametrize("text,want", [("a <b>x</b> c", "a x c"), ("cut <open", "cut "), ("stray > here", "stray  here"), ("", "")])
def test_strip_tags(spark, text, want):
    assert value(spark, fx.strip_tags(F.col("t")), t=text) == want


@pytest.mark.parametrize("text,n,want", [("abcdef", 4, "abcd"), ("éé", 3, "é"), ("日本", 5, "日"), ("ok", 5, "ok")])
def test_truncate_bytes(spark, text, n, want):
    assert value(spark, fx.truncate_bytes(F.col("t"), n), t=text) == want


def test_small_functions(spark):
    assert value(spark, fx.latin_slug(F.col("t")), t="  Hello, World! 9 ") == "hello-world-9"
    assert value(spark, fx.parse_list_literal(F.col("t")), t="['a', 'b c']") == ["a", "b c"]
    assert value(spark, fx.quoted_items(F.col("t")), t="['a', 'b c']") == ["a", "b c"]
    assert value(spark, fx.truncate_chars(F.col("t"), 3), t="abcd") == "abc..."
    assert value(spark, fx.truncate_words(F.col("t"), 4), t="One two. three four five") == "One two."
    assert value(spark, fx.arabic_digits(F.col("t")), t="٢٥٥") == "255"
    assert value(spark, fx.iso_utc(F.lit(0))) == "1970-01-01T00:00:00Z"
    assert value(spark, fx.mentions(F.col("t")), t="see @2:255 and https://x.y/z and @b:1") == ["@2:255", "https://x.y/z", "@b:1"]
    assert value(spark, fx.keyword_class(F.col("t"), [("a", ["x"]), ("b", ["y"])]), t="has Y") == "b"
    assert value(spark, fx.parse_generation(F.col("t"), strict=True), t="tabi'i") == 2
    assert value(spark, fx.verse_ranges(F.col("t")), t="on [2:5-7]") == [5, 6, 7]
    assert value(spark, fx.remove_marks(F.col("t")), t="éa") == "ea"


def test_windows_of_text(spark):
    keys = value(spark, fx.text_windows(F.col("t"), (15, 10)), t="abcdefghijklmnopqrstuvwxyz")
    assert [(k["size"], k["kind"], k["key"]) for k in keys] == [(15, 0, "lmnopqrstuvwxyz"), (10, 0, "qrstuvwxyz"), (10, 1, "ijklmnopqr")]


STEMS = {
    "consistency": "consist", "conspiracy": "conspiraci", "knitting": "knit", "hopping": "hop", "hoping": "hope", "generously": "generous",
    "communities": "communiti", "ties": "tie", "cries": "cri", "gas": "gas", "kiwis": "kiwi", "relational": "relat", "dying": "die", "skies": "sky",
    "controlling": "control", "electrical": "electr", "luxuriating": "luxuri", "by": "by", "say": "say", "été": "été",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def test_lcs_and_segments():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert diff.lcs_length(a, b) == slow(a, b) == diff.lcs_length(b, a)
        d = diff.segments(a, b)
        assert " ".join(s["text"] for s in d["left"]).split() == a and " ".join(s["text"] for s in d["right"]).split() == b
        assert sum(len(s["text"].split()) for s in d["left"] if s["kind"] == "unchanged") == slow(a, b)


def test_segments_of_long_texts():
    def slow(a, b):
        g = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                g[i + 1][j + 1] = g[i][j] + 1 if x == y else max(g[i][j + 1], g[i + 1][j])
        i, j, left, right = len(a), len(b), [], []
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                left.append((a[i], "unchanged"))
                right.append((b[j], "unchanged"))
            elif j and (not i or g[i][j - 1] >= g[i - 1][j]):
                j -= 1
                right.append((b[j], "add"))
            else:
                i -= 1
                left.append((a[i], "delete"))
        return {"left": diff._merged(left[::-1]), "right": diff._merged(right[::-1])}

    rng = random.Random(1)
    sizes = [(rng.randrange(30), rng.randrange(30)) for _ in range(300)] + [(400, 420), (900, 300), (1, 130_000), (130_000, 1)]
    for n, m in sizes:
        a, b = ([rng.choice("abcdefgh" if n < 20 else [*"abcdef", *map(str, range(200))]) for _ in range(k)] for k in (n, m))
        assert diff.segments(a, b) == slow(a, b)
    same = ["w"] * 400
    assert diff.segments(same, same)["left"] == [{"text": " ".join(same), "kind": "unchanged"}]


def test_long_turns_against_sql(spark, tmp_path):
    import duckdb

    from tessera.plans import registry

    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice([*"abcdef", *map(str, range(60))]) for _ in range(n))
    turns = [(1, 0, text(360)), (1, 1, text(350)), (1, 2, text(3)), (2, 0, text(40)), (2, 1, ""), (2, 2, text(5))]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["lcs_segments"]).fetchall()
    assert any("unchanged" in w[2] for w in want if w[:2] == (1, 1))
    assert sorted(map(tuple, registry.QUERIES["lcs_segments"](spark, str(tmp_path)).collect())) == sorted(want)


def test_similarity(spark):
    ratio = lambda a, b: value(spark, diff.similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert ratio("hello world", "hello world") == 1.0
    assert ratio("foo bar", "baz qux") == 0.0
    assert ratio("the prophet said pray five times", "the prophet said fast during ramadan") == 0.5
    assert ratio("", "") == 1.0
    assert ratio("a " * 400, "a " * 400) == 0.0


def test_quotes(spark):
    ok = lambda q, t: value(spark, verify.quote_is_verbatim(F.col("q"), F.col("t")), q=q, t=t)
    assert ok("قال  رسول", "ثم قَالَ رســول الله") and not ok("", "x") and not ok("y", "x")


def edges(spark, rows):
    return spark.createDataFrame([(1, 1, a, b, 1, 1, 0) for a, b in rows], "family long, variant long, src long, dst long, src_gen int, dst_gen int, pos int")


def test_closure_of_a_cycle_with_a_tail(spark):
    rows = {(r["src"], r["dst"]) for r in graph.closure(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])).collect()}
    assert rows == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    assert graph.closure(edges(spark, [])).collect() == []


def test_split_and_edges(spark):
    chain = spark.createDataFrame([(1, 1, i, g, i) for i, g in enumerate([8, 5, 2, 1, 7, 4, 1])], "family long, variant long, node long, gen int, pos int")
    parts = [r["part"] for r in graph.split_by_gap(chain).orderBy("pos").collect()]
    assert parts == [0, 0, 0, 0, 1, 1, 1]
    kept = {(r["src"], r["dst"]) for r in graph.chain_edges(chain).collect()}
    assert kept == {(0, 1), (1, 2), (2, 3), (4, 5), (5, 6)}


def test_walks(spark):
    chain = spark.createDataFrame([(1, v, n, 1, n) for v, n in [(1, 1), (1, 2), (1, 3), (2, 5), (2, 6)]], "family long, variant long, node long, gen int, pos int")
    steps = spark.createDataFrame([(1, 1, 1, 2), (1, 1, 2, 3), (1, 2, 5, 6), (1, 2, 6, 5)], "family long, variant long, src long, dst long")
    rows = sorted((r["variant"], r["step"], r["node"]) for r in graph.greedy_walks(chain, steps).collect())
    assert rows == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 5), (2, 1, 6)]


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    rows = {r["node"]: r["component"] for r in graph.connected_components(pairs).collect()}
    assert rows == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_fusion_bounds_and_search(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "b b c d"), (4, None)], "id long, text string")
    scores = {r["id"]: r["score"] for r in search.bm25(docs, "id", "text", ["a", "b"]).collect()}
    assert set(scores) == {1}
    assert search.bm25(docs, "id", "text", ["zzz"]).collect() == []
    lists = [search.ranked(search.bm25(docs, "id", "text", [t], False), 10) for t in ("a", "b", "c")]
    fused = search.fuse(lists, 10).collect()
    assert all(0 < r["score"] <= 3 / 61 for r in fused) and [r["score"] for r in fused] == sorted((r["score"] for r in fused), reverse=True)


def test_neighbours_with_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0])], "id long, v array<float>")
    got = {(r["id"], r["other"]) for r in search.neighbours(rows, "id", "v", 2, parts=3).collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (2, 1), (3, 3), (3, 2)}


def test_embedding_by_an_injected_model(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    rows = search.embed_with(lambda texts: [[len(t), 1] for t in texts], docs, "id", "text", prefix="").collect()
    assert sorted((r["id"], r["embedding"]) for r in rows) == [(1, [2.0, 1.0]), (2, [0.0, 1.0])]


def test_contexts_and_intents(spark):
    intent = lambda s: tuple(value(spark, context.parse_intent(F.col("t")), t=s))
    assert intent('{"intent":"count","name":"x"}') == ("count", "x")
    assert intent('{"intent":"count","name":" "}') == ("content", None)
    assert intent("not json") == ("content", None)
    rows = spark.createDataFrame([("g", 1, "t", "long text")], "g string, n int, title string, text string")
    blocks = context.context_blocks(rows, "g", "n", "title", "text", 4)
    assert blocks.first()["context"] == "[1] t\nlong..."
    assert context.ask(blocks, "why", lambda p: p[-3:]).first()["answer"] == "why"
    assert context.ask(blocks, "why").first()["answer"].startswith("[1]")


def test_titles_and_fills(spark):
    heads = spark.createDataFrame([("b", 1, "one"), ("b", 10, "ten")], "book string, line long, title string")
    places = spark.createDataFrame([("b", 0), ("b", 1), ("b", 5), ("b", 12)], "book string, line long")
    rows = {r["line"]: r["title"] for r in tree.title_at(heads, places, "book", "line").collect()}
    assert rows == {0: None, 1: "one", 5: "one", 12: "ten"}
    windows = align.next_boundary(spark.createDataFrame([("b", 1), ("b", 4), ("b", 50)], "book string, page long"), "book", "page")
    assert sorted((r["page"], r["stop"]) for r in windows.collect()) == [(1, 4), (4, 24), (50, 70)]
    assert windows.columns == ["book", "page", "stop"]
