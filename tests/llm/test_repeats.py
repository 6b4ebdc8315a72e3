"""Repeated ids, hubs, clashing columns, several tags and token files."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import components, embeddings, fingerprints, jaccard, mixing, packing, tokencount, totals, urlfilter
from tests.llm.test_texts import as_rows, brute_join, frame, near_texts, shingle_set


def text(rng, k=40):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(k))


def changed(t, rng):
    ws = t.split()
    ws[rng.randrange(len(ws))] = "new"
    return " ".join(ws)


def brute_rows(rows):
    """class_id, copies, n_links, component_id of (doc_id, text) rows whose ids may repeat."""
    sets = [frozenset(shingle_set(t)) for _, t in rows]
    classes = {}
    for (i, _), s in zip(rows, sets):
        classes.setdefault(s, []).append(i)
    links = {s: {r for r in classes if r != s and s and r and len(s & r) >= 0.8 * len(s | r) - 1e-9} for s in classes}
    out = []
    for (i, _), s in zip(rows, sets):
        reach, todo = {s}, [s]
        while todo:
            for r in links[todo.pop()] - reach:
                reach.add(r)
                todo.append(r)
        component = min(min(classes[r]) for r in reach)
        out.append((i, min(classes[s]), len(classes[s]), len(links[s]), component, i == component))
    return sorted(out)


def test_join_of_repeated_ids_equals_brute_force(spark):
    rng = random.Random(3)
    a, b, c = text(rng), text(rng), text(rng)
    rows = [(1, a), (1, b), (2, changed(a, rng)), (3, changed(b, rng)), (4, c), (4, c), (5, changed(c, rng)), (2, b), (9, text(rng)), (1, "")]
    docs = frame(spark, [(i, t, "s", 1, 0, "c", 2) for i, t in rows])
    assert sorted(tuple(r) for r in jaccard.jaccard_join(docs).collect()) == brute_rows(rows)


def test_no_group_loses_all_its_texts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = text(rng)
        for _ in range(rng.randrange(1, 4)):
            rows.append((rng.randrange(25), base if rng.random() < 0.4 else changed(base, rng)))
    docs = frame(spark, [(i, t, "s", 1, 0, "c", 2) for i, t in rows] + [(None, rows[0][1], "s", 1, 0, "c", 2)])
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    named = [g for g in got if g[0] is not None]
    sets = {frozenset(shingle_set(t)) for _, t in rows}
    links = {s: {r for r in sets if len(s & r) >= 0.8 * len(s | r) - 1e-9} for s in sets}
    left, groups = set(sets), 0
    while left:
        reach, todo = set(), [left.pop()]
        while todo:
            s = todo.pop()
            if s not in reach:
                reach.add(s)
                todo += links[s]
        left -= reach
        groups += 1
        here = [g for g in named if frozenset(shingle_set(g[1])) in reach]
        members = [i for i, t in rows if frozenset(shingle_set(t)) in reach]
        assert len(here) == 1 and here[0][0] == min(members) and here[0] in rows
    assert len(named) == groups and len(got) == groups + 1


def test_join_recall_on_thousands_of_texts(spark):
    rng = random.Random(11)
    passage = text(rng, 60)
    texts = []
    for i in range(700):
        own = text(rng, 70)
        texts += [f"{passage} {own}", f"{passage} {own.rsplit(' ', 8)[0]} {text(rng, 8)}"]
    texts += [text(rng, 90) for _ in range(1200)]
    want = {(2 * i, 2 * i + 1) for i in range(700)}
    sets = [shingle_set(t) for t in texts[:1400]]
    want = {(a, b) for a, b in want if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r["component_id"], r["doc_id"]) for r in jaccard.jaccard_join(frame(spark, as_rows(texts))).where("not kept").collect()}
    assert len(want) > 600 and got <= want and len(got) >= 0.99 * len(want)


def test_components_of_hubs_paths_and_names(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 500)] + [(1000 + i, 1001 + i) for i in range(60)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    edges += [(5, 5), (None, 3), (3000, 3001), (3001, 3000)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    for kind, name in (("long", lambda x: x), ("string", lambda x: x if x is None else f"{x:05d}")):
        frame_ = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}")
        got = {r["vertex"]: r["component"] for r in components.connected_components(frame_).collect()}
        assert got == {name(v): name(find(v)) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_totals_meet_rows_in_parts(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(1000)], "k int, v int")
    out = totals.with_totals(rows, ["k"], "v", [F.count("*").alias("n"), F.min("v").alias("least")], "n < 600")
    want = {}
    for i in range(1000):
        want.setdefault(i % 3 if i % 2 else 0, []).append(i)
    assert sorted(tuple(r) for r in out.collect()) == sorted((k, v, len(vs), min(vs)) for k, vs in want.items() if len(vs) < 600 for v in vs)


def test_every_vector_of_a_repeated_id_is_compared(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0]), (5, None), (5, [1.0, 1.0]), (None, [1.0, 0.0]), (6, [float("nan"), 1.0])]
    vectors = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, unit string, component int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(vectors).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 1, 1, False), (5, 0, 5, True), (5, 0, 5, True), (None, 0, None, True), (6, 0, 6, True)], key=str)


@pytest.mark.parametrize("clash", ["source_key", "turn", "row", "use", "size", "id", "uses", "_hash", "tie"])
def test_mixing_with_clashing_columns(spark, clash):
    rows = [(i, "w " * (i % 7), "ab"[i % 2], f"{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {clash} string")
    plain = {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs.drop(clash)).collect()}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs).collect()} == plain
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    assert all(r[clash] == str(r["doc_id"]) for r in out.collect())


def test_all_tags_of_a_page_are_edges(spark):
    html = '<link rel="canonical"><link rel=canonical href="//bad.net/"><link href="/other" rel="canonical"><meta http-equiv=refresh content="0; url=http://q.com/">'
    pages = spark.createDataFrame([(1, "http://a.com/x", html), (2, "http://q.com/", ""), (3, "http://a.com/other", ""), (4, "http://z.com/", html.upper())], "page_id long, url string, html string")
    out = {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, urlfilter.rules_frame(spark)).collect()}
    assert out == {1: "block", 2: "block", 3: "block", 4: "block"}
    hub = spark.createDataFrame([(i, f"http://h{i}.com/", '<link rel=canonical href="http://home.net/">') for i in range(400)], "page_id long, url string, html string")
    assert {r["verdict"] for r in urlfilter.judge_urls(hub, urlfilter.rules_frame(spark)).collect()} == {"block"}


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokencount, "READ_BLOCKS", 3)
    files = packing.public_byte_bpe()
    texts = [f"text number {i} " * (i % 9) for i in range(60)]
    docs = frame(spark, as_rows(texts)).repartition(3)
    stream = tokencount.token_stream(docs, files, 50256, block_tokens=32)
    written = tokencount.write_token_files(stream, str(tmp_path / "tokens"))
    counted = {r["doc_id"]: r["tokens"] for r in tokencount.count_tokens(tokencount.read_written(written, block_tokens=32), 50256, block_tokens=32).collect()}
    encode = files.encoder(special_as_text=True)
    want = {i: len(encode(t)) for i, t in enumerate(texts)}
    assert counted == want
    # the same files without what the writer says of them
    bare = tokencount.count_tokens(tokencount.read_token_files(spark, str(tmp_path / "tokens"), block_tokens=32), 50256, block_tokens=32)
    assert sorted(r["tokens"] for r in bare.collect()) == sorted(want.values())
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no multiple"):
        tokencount.read_token_files(spark, str(tmp_path / "odd")).collect()


def test_very_long_texts_in_joins_and_fingerprints(spark):
    rng = random.Random(1)
    long = text(rng, 150_000)
    rows = frame(spark, as_rows([long, long + " tail", "short text of no use at all here", None]))
    out = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in jaccard.jaccard_join(rows).collect()}
    assert out == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3)}
    near = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(rows).collect()}
    assert near[0]["near_next"] > 0.9 and near[2]["near_next"] == 0


def test_near_texts_with_many_copies(spark):
    texts = near_texts(9)
    docs = frame(spark, as_rows(texts))
    want = {i for i, *_, kept in brute_join(texts) if kept}
    assert {r["doc_id"] for r in jaccard.keep_one_of_each(docs).collect()} == want



def test_rows_without_ids_are_spread(spark):
    """A third of all rows have no id and a third one id: no bucket gets more than its share, and sums are still the targets'."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"words of text {i} " * (i % 5 + 1), "s") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.sizes_of(docs)
    hashed = F.md5(F.concat_ws(":", F.lit("0"), F.coalesce("id", F.lit("null")), "tie").cast("binary"))
    most = sizes.groupBy(F.substring(hashed, 1, 2).alias("b")).count().agg(F.max("count")).first()[0]
    assert most < 20
    mixed = mixing.mix_digest(docs)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert mixed.agg(F.sum("taken")).first()[0] == int(total * 1.5)
    again = sorted(map(str, mixing.mix_digest(docs.repartition(7)).collect()))
    assert sorted(map(str, mixed.collect())) == again
