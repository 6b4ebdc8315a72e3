"""Operators that hold with hot groups and elements, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import align, overlap, rag, resolve, scan, skew


def best_overlaps(sets, most):
    out = []
    for i, a in sets.items():
        found = sorted((-len(a & b), j) for j, b in sets.items() if j != i and a & b)[:most]
        out += [(i, j, -n, min(a & sets[j]), r) for r, (n, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,light,tile", [(1, 2, 40), (2, 8, 1000), (3, 1, 17), (4, 1000, 64)])
def test_top_overlaps(spark, seed, light, tile):
    """A word that a third of all sets have, copies of one set, sets of frequent words alone, and sets that nothing links."""
    rng = random.Random(seed)
    sets = {i: {f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(1, 9))} | ({"hot"} if i % 3 == 0 else set()) for i in range(90)}
    sets |= {200 + i: {"hot", "w1", "w2", "x9"} for i in range(25)} | {300 + i: {"hot"} for i in range(9)} | {400 + i: {f"own{i}"} for i in range(5)}
    rows = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, element string")
    got = overlap.top_overlaps(rows.unionAll(rows.where("id < 20")), 5, light=light, tile=tile)
    assert sorted(map(tuple, got.collect())) == best_overlaps(sets, 5)


def test_top_overlaps_of_nothing(spark):
    assert overlap.top_overlaps(spark.createDataFrame([], "id long, element string")).collect() == []
    alone = spark.createDataFrame([(1, "a"), (2, "b")], "id long, element string")
    assert overlap.top_overlaps(alone).collect() == []


def test_meet_deals_a_hot_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(1)).alias("k"), F.col("id").alias("v"))
    table = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    got = skew.meet(rows, table, ["k"], "v").collect()
    assert Counter((r["k"], r["v"], r["name"]) for r in got) == Counter((r["k"], r["v"], f"n{r['k']}") for r in rows.collect())
    counts = {r["v"]: r["n"] for r in skew.with_counts(rows, "k", "v", "n").collect()}
    assert counts[2] == sum(r["k"] == 1 for r in rows.collect()) and counts[3] == 1


def grouped(rng, n):
    return [(None if i % 11 == 0 else "hot" if i % 5 else f"g{i % 3}", i, rng.choice([None, None, i * 10])) for i in rng.sample(range(n), n)]


def test_fill_in_two_levels(spark):
    rows = grouped(random.Random(3), 600)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    last, want = {}, []
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        last[g] = v if v is not None else last.get(g)
        want.append((g, o, v, last[g]))
    key = lambda r: r[1]
    assert sorted(map(tuple, scan.fill(df, "g", ["o"], "v", "f").collect()), key=key) == want
    assert sorted(map(tuple, align.fill_backward(df, "g", "o", "v", "f").collect()), key=key) == want


def test_following_and_sums_in_two_levels(spark):
    rows = grouped(random.Random(4), 500)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    ahead, total, nexts, sums = {}, {}, {}, {}
    for g, o, _ in sorted(rows, key=lambda r: -r[1]):
        nexts[o], ahead[g] = ahead.get(g), o
    for g, o, _ in sorted(rows, key=lambda r: r[1]):
        total[g] = sums[o] = total.get(g, 0) + o
    assert {r["o"]: r["n"] for r in scan.following(df, "g", "o", "n").collect()} == nexts
    assert {r["o"]: r["s"] for r in scan.running_sum(df, "g", ["o"], F.col("o"), "s").collect()} == sums


def test_one_group_of_all_rows_is_dealt_over_parts(spark):
    rows = spark.range(4000).select(F.lit("all").alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 900 == 7, F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one part
    try:
        sizes = [r["count"] for r in scan.dealt(rows.repartition(8), "g", ["o"]).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and max(sizes) < 0.6 * 4000
    got = {r["o"]: r["f"] for r in scan.fill(rows, "g", ["o"], "v", "f").collect()}
    assert got == {o: None if o < 7 else (o - 7) // 900 * 900 + 7 for o in range(4000)}
    assert scan.fill(rows.limit(0), "g", ["o"], "v", "f").collect() == []


def test_substrings_inside_longer_words(spark):
    rng = random.Random(6)
    name = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    longs = [name(rng.randrange(5, 40)) for _ in range(120)] + ["see xabcdefghij klmnopq", "common prefix of very many " + "z" * 3] * 2
    shorts = [x[k : k + rng.randrange(4, 15)] for x in longs for k in (0, 3)] + ["abcdefghij klmno", "common prefix of"]
    a = spark.createDataFrame(list(enumerate(shorts)), "i long, inner string")
    b = spark.createDataFrame(list(enumerate(longs)), "j long, outer string")
    got = {(r["i"], r["j"]) for r in resolve.substring_pairs(a, "inner", b, "outer", 8).collect()}
    assert got == {(i, j) for i, s in enumerate(shorts) for j, t in enumerate(longs) if len(s) >= 8 and s in t}
    names = spark.createDataFrame([(1, "abcdefghij klmno", "q")], "id long, short string, full string")
    forms = spark.createDataFrame([(5, "see xabcdefghij klmnopq", "somebody")], "other long, form string, name string")
    assert [tuple(r) for r in resolve.resolve_names(names, forms).collect()] == [(1, 5, "substring", 1)]


@pytest.mark.parametrize("most", [60, 100, 1000, 100_000])
def test_contexts_are_gathered_up_to_their_bound(spark, most):
    rng = random.Random(8)
    rows = [(g, i, rng.choice(["t", "ü"]), "é" * rng.randrange(0, 90)) for g in ("a", "b", None) for i in range(rng.randrange(1, 12))] + [("c", 1, "t", "x" * 5000)]
    df = spark.createDataFrame(rows, "g string, line long, title string, text string")
    want = {}
    for g, i, title, text in sorted(rows, key=lambda r: r[1]):
        want[g] = want.get(g, "") + f"--- [{title}] (line {i}) ---\n{text}\n\n"
    got = {r["g"]: (r["bytes"], r["context"]) for r in rag.answer_context(df, "g", most).collect()}
    assert set(got) == set(want)
    for g, whole in want.items():
        size = len(whole.encode())
        cut = whole.encode()[:most].decode(errors="ignore") + "\n... (content truncated)\n" if size > most else whole
        assert got[g] == (size, cut)


def edge_rows(spark, rows):
    """family, variant, src, dst with generations that run against each other where src < dst."""
    return spark.createDataFrame([(f, v, s, d, s, d, 0) for f, v, s, d in rows], "family long, variant long, src long, dst long, src_gen long, dst_gen long, pos long")


def test_another_variants_edge_leads_through_a_chain(spark):
    from tessera.operators import graph, structure

    chain = [(1, 10, 7, 4, 0), (1, 10, 5, 1, 1), (1, 11, 7, 4, 0), (1, 11, 5, 1, 1), (1, 11, 3, 2, 2), (2, 20, 1, 1, 0), (2, 20, 2, 5, 1)]
    chains = spark.createDataFrame(chain, "family long, variant long, node long, gen int, pos int")
    edges = edge_rows(spark, [(1, 11, 7, 5), (1, 11, 5, 3), (2, 20, 1, 2), (2, 20, 2, 1)])
    walk = sorted(map(tuple, graph.greedy_walks(chains, edges).collect()))
    assert walk == [(1, 10, 0, 7), (1, 10, 1, 5), (1, 11, 0, 7), (1, 11, 1, 5), (1, 11, 2, 3), (2, 20, 0, 1), (2, 20, 1, 2)]
    facts = {r["variant"]: r for r in structure.chain_facts(chains, edges).collect()}
    assert (facts[10]["continuity"], facts[10]["nodes"], facts[10]["conflict"]) == ("muttasil", [7, 5], False)
    assert facts[20]["conflict"] and facts[20]["node_count"] == 2
    missing = {r["variant"]: (r["missing"], r["continuity"]) for r in structure.continuity(chains, edge_rows(spark, [(1, 11, 5, 3)])).collect()}
    assert missing[10] == (0, "muttasil") and missing[20] == (0, "muttasil")  # each walks to one node alone, without a gap


def test_ego_graphs(spark):
    from tessera.operators import graph

    rng = random.Random(9)
    pairs = {(0, i) for i in range(1, 60)} | {(i, 1) for i in range(30, 80)} | {(rng.randrange(80), rng.randrange(80)) for _ in range(300)}
    pairs = {(a, b) for a, b in pairs if a != b}
    nodes = spark.range(90).withColumnRenamed("id", "node")
    got = {r["node"]: r for r in graph.ego_graphs(nodes, spark.createDataFrame(sorted(pairs), "src long, dst long"), 25).collect()}
    assert len(got) == 90
    for n, r in got.items():
        up, down = sorted(b for a, b in pairs if a == n), sorted(a for a, b in pairs if b == n)
        shown = {n, *up[:25], *down[:25]}
        assert (r["teachers"], r["students"], r["total_teachers"], r["total_students"]) == (up[:25], down[:25], len(up), len(down))
        assert [tuple(x) for x in r["links"]] == sorted((a, b) for a, b in pairs if a in shown and b in shown)


def test_bitmaps_against_plain_closures(spark):
    """Families of up to 150 nodes, cycles, and nodes without an edge."""
    from tessera.operators import bitmaps, graph

    rng = random.Random(12)
    pairs = {(1, a, a + rng.randrange(1, 5)) for a in range(0, 140, 2)} | {(1, 100, 90), (2, 5, 6), (2, 6, 5), (3, 1, 2)} | {(4, rng.randrange(70), rng.randrange(70)) for _ in range(80)}
    chain = [(f, f * 10 + k % 7, n, n % 5, k) for f in (1, 2, 3, 4) for k, n in enumerate(sorted({x for g, a, b in pairs if g == f for x in (a, b)} | {200}))]
    chains = spark.createDataFrame(chain, "family long, variant long, node long, gen int, pos int")
    edges = edge_rows(spark, [(f, 0, a, b) for f, a, b in pairs])
    up = {}
    for f, n in {(r[0], r[2]) for r in chain}:
        seen, todo = set(), [n]
        while todo:
            for g, a, b in pairs:
                if (g, a) == (f, todo[-1]) and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.pop()
        up[f, n] = seen
    down = {k: {n for (f, n), s in up.items() if f == k[0] and k[1] in s} for k in up}
    assert {(r["family"], r["src"], r["dst"]) for r in graph.closure(edges).collect()} == {(f, n, x) for (f, n), s in up.items() for x in s}
    found = bitmaps.reach(edges, chains)
    degree = graph.degrees(chains, edges)
    students = {k: len({a for f, a, b in pairs if (f, b) == k}) for k in up}
    ends = {k: sum(students[k[0], x] == 0 for x in s) for k, s in down.items()}
    assert {(r["family"], r["node"]): r["terminals"] for r in bitmaps.terminals(found, degree).collect()} == {k: n for k, n in ends.items() if n}
    single = {k: sum(students[k[0], x] == 1 for x in s) / len(s) for k, s in up.items() if s}
    assert {(r["family"], r["node"]): round(r["ratio"], 9) for r in bitmaps.single_strand_ratio(found, degree).collect()} == {k: round(v, 9) for k, v in single.items()}
    held = {}
    for f, v, n, *_ in chain:
        held.setdefault((f, v), set()).add(n)
    passed = {k: sum(k[1] not in s and bool(s & (up[k] - {k[1]})) and bool(s & (down[k] - {k[1]})) for (f, _), s in held.items() if f == k[0]) for k in up}
    assert {(r["family"], r["node"]): r["bypasses"] for r in bitmaps.bypasses(chains, found).collect()} == {k: n for k, n in passed.items() if n}
    some = spark.createDataFrame([(1, 40), (4, 3)], "family long, node long")
    assert {(r["family"], r["node"]) for r in bitmaps.bypasses(chains, found, some).collect()} <= {(1, 40), (4, 3)}
    known = spark.createDataFrame([(n,) for n in range(0, 201, 3)], "node long")
    around = {k: up[k] | down[k] | {k[1]} for k in up}
    share = {k: round(sum(x % 3 == 0 and x < 201 for x in s) / len(s), 9) for k, s in around.items()}
    assert {(r["family"], r["node"]): round(r["completeness"], 9) for r in bitmaps.provenance_completeness(found, known).collect()} == share


@pytest.mark.parametrize("clustered,rows,part", [(True, 1500, 60), (False, 300, 40), (True, 300, 4096)])
def test_pruned_neighbours_are_exact(spark, clustered, rows, part):
    import numpy as np

    from tessera.operators import near

    rng = np.random.default_rng(5)
    if clustered:
        x = rng.normal(size=(25, 16))[rng.integers(0, 25, rows)] + 0.05 * rng.normal(size=(rows, 16))
    else:
        x = rng.normal(size=(rows, 16))
    x[7] = x[8]  # equal scores
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, [0.0] * 16), (9002, None), (9003, [float("nan")] * 16), (None, [1.0] * 16)]
    told = {}
    got = near.neighbours(spark.createDataFrame(data, "id long, v array<double>"), "id", "v", 6, part_rows=part, told=told)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 9)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], []).append((r["rank"], r["other"], round(r["score"], 9)))
    assert len(found) == rows
    for i, list_ in found.items():
        want = sorted(range(rows), key=lambda j: (-scores[i, j], j))[:6]
        assert [o for _, o, _ in sorted(list_)] == want or [s for *_, s in sorted(list_)] == pytest.approx([scores[i, j] for j in want], abs=1e-8)
    if clustered and part < rows:
        assert told["compared"] < 0.5 * told["blocks"]


def test_neighbours_of_nothing(spark):
    from tessera.operators import near

    empty = spark.createDataFrame([], "id long, v array<double>")
    assert near.neighbours(empty, "id", "v", 3).collect() == []


def test_short_fragments_meet_words_by_their_runs(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    cuts = [t[k : k + n] for t in texts for k, n in ((0, 1), (1, 4), (2, 7))] + ["zz", "a z", " ", "  "]
    short = [f for f in cuts if f and len(f.strip(" ").split(" ")) < 3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    fragments = spark.createDataFrame(list(enumerate(short)), "probe long, fragment string")
    plain = fragments.where(align.inner_word(F.col("fragment")).isNull())
    met = align.short_hits(align.words_of(docs, "id"), plain).select("id", "probe", "fragment").distinct()
    got = {(r["id"], r["probe"]) for r in met.join(docs, "id").where(F.contains("text", "fragment")).collect()}
    kept = {r["probe"] for r in plain.collect()}
    blank = {i for i, f in enumerate(short) if not f.strip(" ")}  # a text of blanks alone has no word
    want = {(i, j) for i, t in enumerate(texts) for j, f in enumerate(short) if j in kept and f in t and t.strip(" ")}
    assert {x for x in got if x[1] not in blank} == {x for x in want if x[1] not in blank} and got <= want


@pytest.mark.parametrize("least", [1, 2, 3])
def test_overlaps_of_at_least(spark, least):
    rng = random.Random(14)
    sets = {(g, k): set(rng.sample(range(14), rng.randrange(0, 7))) | ({99} if k % 4 else set()) for g in (1, 2) for k in range(30)}
    rows = spark.createDataFrame([(g, k, e) for (g, k), s in sets.items() for e in s], "g long, k long, e long")
    got = sorted(map(tuple, overlap.at_least(rows, "g", "k", "e", least).collect()))
    assert got == sorted((g, a, b, len(s & t)) for (g, a), s in sets.items() for (h, b), t in sets.items() if g == h and a < b and len(s & t) >= least)


def test_words_from_segments(spark):
    from tessera.operators import words

    rows = [(1, 2, "c", "N", {"ROOT": "r", "LEM": "l", "gender": "M"}), (1, 1, "b", "P", {"affix": "PREF", "type": "CONJ"}), (1, 3, "d", "PRON", {"affix": "SUFF"}), (2, 1, "x", "P", {"affix": "PREF", "case": "GEN"}), (3, 1, "y", "V", {})]
    got = {r["w"]: r for r in words.fold_segments(spark.createDataFrame(rows, "w long, s long, form string, tag string, features map<string,string>"), ["w"], "s").collect()}
    assert (got[1]["text"], got[1]["pos"], got[1]["root"], got[1]["lemma"], got[1]["features"]) == ("bcd", "N", "r", "l", {"gender": "M"})
    assert [tuple(x) for x in got[1]["segments"]] == [("b", "P", "PREF", None), ("c", "N", None, "r"), ("d", "PRON", "SUFF", None)]
    assert (got[2]["pos"], got[2]["features"]) == ("P", {"case": "GEN"}) and (got[3]["root"], got[3]["features"]) == (None, {})


def test_components_of_a_long_path_settle_in_few_rounds(spark):
    from tessera.operators import graph

    ids = random.Random(3).sample(range(10_000), 600)
    path = spark.createDataFrame(list(zip(ids, ids[1:])) + [(7, 7), (20_000, None), (20_001, 20_002)], "a long, b long")
    rows = {r["node"]: r["component"] for r in graph.connected_components(path, most_rounds=9).collect()}
    assert rows == {i: min(ids) for i in ids} | {20_001: 20_001, 20_002: 20_001}


def test_stored_rows_forget_the_estimate_of_their_plan(spark):
    from tessera.operators.storage import materialize

    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    rows = spark.range(50).withColumnRenamed("id", "a")
    for _ in range(4):
        rows = materialize(rows.join(rows.withColumnRenamed("a", "b"), rows["a"] == F.col("b")).select("a"))
    assert rows.count() == 50 and size(rows) < 1_000_000


@pytest.mark.parametrize("part", [40, 500])
def test_neighbours_among_many_equal_vectors(spark, part):
    import numpy as np

    from tessera.operators import near

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8))
    x[50:250] = x[50] * rng.integers(1, 4, 200)[:, None]
    x[250:] = x[0] + 1e-9 * rng.normal(size=(50, 8))
    got = near.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v", 5, part_rows=part)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], []).append((r["rank"], r["other"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(u @ u.T, 12)
    for i in range(50, 250):
        assert sorted(found[i]) == [(n + 1, 50 + n) for n in range(5)]
    for i, list_ in found.items():
        assert [scores[i, o] for _, o in sorted(list_)] == pytest.approx(sorted(scores[i], reverse=True)[:5], abs=2e-12)


def test_blocks_give_back_only_what_beats_the_neighbours_at_home():
    import pandas as pd

    from tessera.operators import near

    x = pd.DataFrame({"id": [1, 2], "v": [[1.0, 0.0], [0.0, 1.0]], "worst": [0.9, -2.0]})
    y = pd.DataFrame({"other": [5, 3, 4], "w": [[1.0, 1.0], [2.0, 2.0], [1.0, 0.1]]})
    got = near._block(2)(x.assign(v=x["v"].map(list)), y)
    assert [tuple(r) for r in got[["id", "other"]].itertuples(index=False)] == [(1, 4), (2, 3), (2, 5)]


def test_prefixes_that_many_names_share(spark):
    left = [(i, "one two three four five six") for i in range(400)] + [(1000, "a b c d x"), (1001, "a b c d y"), (1002, "p q r z"), (1003, "u v w z"), (1004, "same")]
    right = [(i, "one two three four 5") for i in range(400, 0, -1)] + [(None, "a b c d"), (900, "a b c d"), (901, "a b c d x e"), (902, "p q r s"), (903, "u v w s"), (904, "u v w t"), (906, "same"), (905, "same")]
    frames = [spark.createDataFrame(rows, "id long, name string") for rows in (left, right)]
    got = {r["id"]: (r["other"], r["step"]) for r in align.prefix_match(*frames).collect()}
    assert got == {i: (1, "four") for i in range(400)} | {1000: (901, "four"), 1001: (900, "four"), 1002: (902, "three"), 1004: (905, "exact")}


def test_zipped_ranges_longer_than_a_block(spark):
    chapters = [("g", "a", -5, 9000), ("g", "b", 4000, 4100), ("g", "c", 8000, 20_000), ("g", "d", 30_000, 29_000), ("h", "a", 7, 7), ("h", "b", 7, 8)]
    pages = [("g", 10), ("g", 11), ("g", 12), ("g", 13), ("h", 5)]
    rows = align.ordinal_zip(spark.createDataFrame(chapters, "grp string, chapter string, low long, high long"), spark.createDataFrame(pages, "grp string, page long"))
    want = {("g", n): 11 if 4000 <= n <= 4100 else 12 if n >= 8000 else 10 for n in range(-5, 20_001)} | {("h", 7): 5}
    assert sorted(map(tuple, rows.collect())) == sorted((g, n, p) for (g, n), p in want.items())


def test_segments_of_a_batch_are_never_all_python_objects():
    import tracemalloc

    import pyarrow as pa

    from tessera.operators import diff

    rows = [" ".join(f"w{(i * k) % 97}" for k in range(120)) for i in range(1500)]
    a, b = pa.array(rows + [None, "x y"]), pa.array(rows[1:] + rows[:1] + ["x", None])
    tracemalloc.start()
    made = diff._diff(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 1502 and peak < 8_000_000
    assert made[3].as_py() == diff.segments(rows[3].split(), rows[4].split()) and made[1501].as_py() == {"left": [{"text": "x y", "kind": "delete"}], "right": []}


def test_copies_of_sets_in_tiles():
    from tessera.operators import overlap

    def copies(classes):
        parts = -(-classes // overlap.TILE)
        return parts + overlap.tile_sides(classes, parts)

    assert copies(1_600_000) <= 40 and overlap.tile_sides(130_000, 1) == 8 and overlap.tile_sides(10, 1) == 1
    assert overlap.tile_sides(1000, 10, 100) == 10


def test_overlaps_by_parts_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART_ROWS", 16)
    rng = random.Random(2)
    sets = {(g, k): set(rng.sample(range(12), 4)) for g in range(3) for k in range(15)}
    rows = spark.createDataFrame([(g, k, e) for (g, k), s in sets.items() for e in s], "g long, k long, e long")
    want = sorted((g, a, b, len(sets[g, a] & sets[g, b])) for g in range(3) for a in range(15) for b in range(a + 1, 15) if len(sets[g, a] & sets[g, b]) >= 2)
    assert sorted(map(tuple, overlap.at_least(rows, "g", "k", "e", 2).collect())) == want


@pytest.mark.parametrize("local", [0, 40, 10_000])
def test_families_are_closed_in_a_row_or_by_rounds(spark, monkeypatch, local):
    from tessera.operators import bitmaps

    monkeypatch.setattr(bitmaps, "LOCAL", local)
    rng = random.Random(4)
    edges = [(f, *(rng.randrange(n) * 7 - 20 for _ in "ab")) for f, n, m in ((1, 5, 6), (2, 150, 170), (3, 70, 300), (4, 2, 1)) for _ in range(m)]
    lone = [(1, 999), (5, 3)]
    found = bitmaps.reach(spark.createDataFrame(edges, "family long, src long, dst long"), spark.createDataFrame(lone, "family long, node long"))
    want = {(f, a, b) for f, a, b in edges}
    while True:
        more = {(f, a, d) for f, a, b in want for g, c, d in edges if f == g and b == c} - want
        if not more:
            break
        want |= more
    assert {tuple(r) for r in found.pairs().collect()} == want


def test_edges_are_read_from_stored_chains(spark, monkeypatch):
    from tessera.operators import graph
    from tessera.plans import graph_queries

    stored = []
    monkeypatch.setattr(graph_queries, "materialize", lambda df, keep=graph_queries.materialize: stored.append(df) or keep(df))
    _, chains, edges = graph_queries._stored(spark, "/root/testdata/sf0.001")
    assert len(stored) == 1 and "Exchange" not in edges._jdf.queryExecution().sparkPlan().toString()
    assert chains.columns == ["variant", "family", "node", "gen", "pos"]
    assert edges.count() > 0 and edges.exceptAll(graph.chain_edges(chains)).isEmpty() and graph.chain_edges(chains).exceptAll(edges).isEmpty()
