"""URL filters, fingerprints and mixing against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fingerprints, mixing, urlfilter
from tessera.llm.components import connected_components
from tessera.llm.ordering import with_position

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, position string, key int")


def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, rule string")
    redirects = redirects and spark.createDataFrame(redirects, "src_url string, dst_url string")
    out = urlfilter.judge_urls(pages, urlfilter.rules_frame(spark), redirects).collect()
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", None, 0, ""),
        (2, "http://example.net/fr/1", "", 0, ""),
        (3, "https://b.org/fr/x", "<p>", 0, ""),
        (4, "nothing", "", 0, ""),
        (5, None, "", 0, ""),
        (6, "http://notexample.com/de/", "", 0, ""),
        (7, "http://x.example.com/de/a", "", 0, ""),
        (8, "http://net", "", 0, ""),
        (9, "http://Ünet.COM?q=/", "", 0, ""),
    ]
    got = judged(spark, rows)
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.net", "/fr/1", "net/", "block"),
        3: ("b.org", "/fr/x", "org/fr/", "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("notexample.com", "/de/", None, "allow"),
        7: ("x.example.com", "/de/a", "example.com/de/", "block"),
        8: ("net", "", None, "allow"),
        9: ("Ünet.com", "", None, "allow"),
    }


def test_aliases_take_blocks_and_explicit_allows_win(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.com/x#top", link.format("//bad.net/"), 0, ""),
        (2, "http://c.com/y", '<meta http-equiv="refresh" content="0; url=http://a.com/x">', 0, ""),
        (3, "http://bad.net/", "", 0, ""),
        (4, "http://d.com/", link.format("http://bad.net/2"), 0, ""),
        (5, "http://e.com/", link.format("http://f.org/fr/1"), 0, ""),
        (6, "http://other.com/", link.format("/self"), 0, ""),
    ]
    redirects = [("http://bad.net/2", "http://e.com/"), (None, "http://c.com/y"), ("http://z.com", "z")]
    got = judged(spark, rows, redirects)
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_no_pages(spark):
    assert judged(spark, []) == {}


def brute_components(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
    [(random.Random(4).randrange(80), random.Random(i).randrange(80)) for i in range(60)], [(3, 3), (5, 4), (4, 5)],
])
def test_components(spark, edges):
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in connected_components(frame).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def test_positions(spark):
    values = [5, 3, 9, 3, -1, 100, 42, 7]
    rows = with_position(spark.createDataFrame([(v,) for v in values], "v long"), "v").collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["position"])] == sorted(values)
    assert sorted(r["position"] for r in rows) == list(range(len(values)))


def shingle_set(text):
    words = SPLIT.findall(text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_edits(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = {i * 3: " ".join(rng.choices(words, k=rng.randrange(0, 90))) for i in range(30)}
    texts[6] = texts[9]
    texts[12] = None
    texts[15] = "Ünïcode 😀 x"
    rows = [(i, t, None, None, "p", 1) for i, t in texts.items()] + [(None, "a b c d e f", None, None, "p", 1)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs_frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(texts)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        # fewer shingles than the sketch holds: estimates are exact
        assert got[i]["near_edited"] == pytest.approx(likeness(shingle_set(text), shingle_set(edited)))
        assert got[i]["near_next"] == pytest.approx(likeness(shingle_set(text), shingle_set(after)))
        assert got[i]["shingles"] == len(shingle_set(text))
    assert got[6]["fingerprint"] == got[9]["fingerprint"]
    assert got[None]["near_next"] == 0  # the contract: from 0 to 1; an empty text stands for the next


def test_repeated_ids_have_one_neighbour(spark):
    rows = [(1, "a b c d e f g h", None, 0, "", 0), (2, "x y z u v w", None, 0, "", 0), (2, "k l m n o p", None, 0, "", 0)]
    got = fingerprints.fingerprint_edits(docs_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 2]
    assert fingerprints.fingerprint_edits(docs_frame(spark, [])).collect() == []


def test_sketches_merge_and_estimate(spark):
    parts = [" ".join(f"t{i}" for i in range(a, b)) for a, b in ((0, 3000), (1500, 4000))]
    row = spark.createDataFrame([tuple(parts)], "a string, b string").select(
        fingerprints.bottom_k(F.col("a")).alias("a"), fingerprints.bottom_k(F.col("b")).alias("b")
    )
    row = row.select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"),
        fingerprints.containment(F.col("b"), F.col("a")).alias("c"),
        fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n"),
    ).first()
    assert row["r"] == pytest.approx(1496 / 3996, abs=0.13)
    assert row["c"] == pytest.approx(0.6, abs=0.25)
    assert row["n"] == pytest.approx(3996, rel=0.25)


def brute_targets(sizes, weights=(5, 2, 1), demand=1.5, most=2.0):
    order = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), demand * sum(sizes.values())
    while True:
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) >= most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return target | {s: weight[s] * left / sum(weight[x] for x in free) for s in free}


def mixed_rows(seed=3):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", "hot", "hot", "hot", None]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice(sources), 0, "p", 1) for i in range(300)]
    return rows + [(7, "again again", "a", 0, "p", 1), (7, "again again", "a", 0, "p", 1), (None, "no id", "a", 0, "p", 1), (900, None, None, 0, "p", 1)]


def test_mix_reaches_targets(spark):
    rows = mixed_rows()
    out = mixing.mix_digest(docs_frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(SPLIT.findall(text or ""))
    want = brute_targets(sizes)
    assert sorted({round(r["target"], 6) for r in out}) == sorted({round(x, 6) for x in want.values()})
    assert sum(r["taken"] for r in out) == sum(int(round(x, 6)) for x in want.values())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    firsts = [r["first_position"] for r in out if r["first_position"] is not None]
    assert firsts == sorted(firsts) and 0 <= firsts[0] and firsts[-1] <= 1
    again = mixing.mix_digest(docs_frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_documents(spark):
    rows = mixed_rows(5)
    plan = mixing.mix_digest(docs_frame(spark, rows)).collect()
    docs = mixing.mix_documents(docs_frame(spark, rows))
    assert docs.columns == ["doc_id", "text", "source", "n_chars", "position", "key"]
    words = {}
    for r in docs.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(SPLIT.findall(r["text"]))
    want = {}
    for r in plan:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert words == {k: v for k, v in want.items() if v}


def test_long_document_taken_in_part(spark):
    long = "  a\n" + "bb \tc " * 30_000
    rows = [(1, long, "a", 0, "p", 1), (2, "x " * 90_000, "b", 0, "p", 1), (3, "x " * 90_000, "c", 0, "p", 1)]
    plan = {r["doc_id"]: r for r in mixing.mix_digest(docs_frame(spark, rows)).collect()}
    texts = {}
    for r in mixing.mix_documents(docs_frame(spark, rows)).collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    sources = dict((r[0], r[1]) for r in rows)
    for i, found in texts.items():
        assert all(sources[i].startswith(t) for t in found)
        assert sum(len(SPLIT.findall(t)) for t in found) == plan[i]["taken"]


def test_mix_of_nothing(spark):
    assert mixing.mix_digest(docs_frame(spark, [])).collect() == []
    only = mixing.mix_digest(docs_frame(spark, [(1, "", "a", 0, "", 0), (2, None, None, 0, "", 0)])).collect()
    assert [r["taken"] for r in only] == [0, 0]


def test_schedules_invert(spark):
    for knots in mixing.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        got = spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.invert_schedule(F.col("s"), knots).alias("t")).collect()
        total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
        for s, row in zip(shares, got):
            area = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                x = min(max(row["t"] - t0, 0), t1 - t0)
                area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert area / total == pytest.approx(s, abs=1e-9)
