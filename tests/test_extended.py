"""Stored indexes, plans around a model, guards, repaired readers and sinks."""

import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, guards, order, rag, search, storage, structure, tree, vector_index
from tessera.operators.cache import TtlCache
from tessera.sources import files, rest, seeds, sinks


def test_index_query_reads_its_terms_alone(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the word{'abcdefg'[i % 7]} of all" if i % 3 else "nothing here") for i in range(60)] + [(99, None)], "id long, text string")
    path = str(tmp_path / "index")
    search.write_index(docs, "id", "text", path, buckets=16)
    hits = search.search_index(spark, path, ["the", "wordd"])
    plan = hits._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(token" in plan
    assert {r["id"] for r in hits.collect()} == {i for i in range(60) if i % 3 and i % 7 == 3}
    want = {r["id"]: r["score"] for r in search.bm25(docs, "id", "text", ["the", "wordd"]).collect()}
    assert {r["id"]: r["score"] for r in hits.collect()} == pytest.approx(want)
    assert {r["id"] for r in search.search_index(spark, path, ["wordd", "absent"], conjunctive=False).collect()} == set(want)
    assert search.search_index(spark, path, ["the", "absent"]).collect() == []


def test_index_keeps_blocks_and_not_rows_of_postings(spark, tmp_path):
    texts = ["Things and the thing", "no such word", "", "THE the Thinged things", None, "the end"] * 30
    docs = spark.createDataFrame([(i if i != 7 else None, x) for i, x in enumerate(texts)], "id long, text string").coalesce(2)
    path = str(tmp_path / "index")
    search.write_index(docs, "id", "text", path, buckets=8, lower=True, stem=True)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.where("token = 'the'").count() <= 2 and stored.where("token = 'the'").selectExpr("sum(size(ids))").first()[0] == 90
    assert tuple(spark.read.parquet(f"{path}/statistics").first())[0] == 150
    plain = docs.withColumn("text", F.regexp_replace(F.lower("text"), "thing(s|ed)", "thing"))
    want = {r["id"]: r["score"] for r in search.bm25(plain.where("id is not null or text is null"), "id", "text", ["thing", "the"]).collect()}
    got = {r["id"]: r["score"] for r in search.search_index(spark, path, ["thing", "the"]).collect()}
    assert set(got) == set(want) and len(want) == 60


def test_vector_index_is_exact_and_reads_few_lists(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    x = np.concatenate([c + 0.15 * rng.standard_normal((50, 16)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16)]
    path = str(tmp_path / "vectors")
    vector_index.write_vector_index(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", path)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in (0, 333, 777):
        got = [r["id"] for r in vector_index.nearest(spark, path, x[q].tolist(), 10, probes=1).collect()]
        s = np.round(unit @ unit[q], 6)
        assert set(got) == set(np.lexsort((np.arange(len(s)), -np.round(unit @ unit[q], 9)))[:10])
        assert s[got[0]] == 1
    near = vector_index.nearest(spark, path, x[0].tolist(), 10)
    listed = near._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < listed.count(",") < 20


def test_guards(spark):
    assert guards.page_bounds(3, 500) == (200, 100) and guards.page_bounds(0, 0) == (0, 1) and guards.page_bounds(None, None) == (0, 20)
    assert guards.window_bounds(-3, 900, 50) == (0, 50) and guards.window_bounds(5, 5, 50) == (5, 6)
    assert guards.updatable("narrator", "name_en") == ("narrator", "name_en")
    for table, field in (("hadith", "id"), ("users", "text_en"), ("hadith", "text_en; drop")):
        with pytest.raises(ValueError):
            guards.updatable(table, field)
    vectors = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "id long, v array<float>")
    guards.require_length(vectors, "v", 2)
    guards.require_length(vectors.where("v is null"), "v", 7)
    with pytest.raises(ValueError, match="2 components"):
        guards.require_length(vectors, "v", 3)


def test_cache_forgets():
    now = [0.0]
    cache = TtlCache(ttl=10, most=4, clock=lambda: now[0])
    for k in range(4):
        now[0] += 1
        cache.put(k, k * k)
    assert cache.get(3) == 9 and len(cache) == 4
    cache.put(9, 81)
    assert [k for k in (0, 1, 2, 3, 9) if cache.get(k) is not None] == [2, 3, 9]
    now[0] = 13.5
    assert cache.get(2) is None and cache.get(9) == 81
    cache.put(4, 16)
    cache.put(5, 25)
    assert cache.get(9) == 81 and cache.get(4) == 16 and cache.get("none", 7) == 7


TURTLE = '''@prefix : <http://x.org/> .
PREFIX r: <http://r.org/rel#>
# a comment
:a r:follows :b ; r:name "A \\"quoted\\"\\n"@en, "second"^^r:text ;
   a r:Node .
<http://x.org/b> r:follows :c . _:n r:count 12 . :c r:text """long
text""" ; .
'''


def test_turtle(spark, tmp_path):
    got = list(files.turtle_triples(TURTLE))
    x, r = "http://x.org/", "http://r.org/rel#"
    assert got == [
        (x + "a", r + "follows", x + "b"), (x + "a", r + "name", 'A "quoted"\n'), (x + "a", r + "name", "second"),
        (x + "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", r + "Node"), (x + "b", r + "follows", x + "c"), ("_:n", r + "count", "12"), (x + "c", r + "text", "long\ntext"),
    ]
    for bad in (":a :b :c .", "<a:a> <a:b> <a:c>", "<a:a> <a:b> .", "<a:a> [ ] ."):
        with pytest.raises(ValueError):
            list(files.turtle_triples(bad))
    (tmp_path / "a.ttl").write_text(TURTLE)
    assert sorted(map(tuple, files.read_turtle(spark, str(tmp_path)).collect())) == sorted(got)


def test_lists_of_any_length_and_rings(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("h", "a"), ("a", "b"), ("b", "a"), ("x", "y"), ("y", "x")]
    triples = spark.createDataFrame([(s, "next", o) for s, o in links] + [("n1", "other", "n0")], "s string, p string, o string")
    got = {}
    for r in files.follow_chain(triples, "next").collect():
        got.setdefault(r["head"], {})[r["pos"]] = r["node"]
    assert got == {"n0": {i: f"n{i}" for i in range(71)}, "h": {0: "h", 1: "a", 2: "b"}}
    rows = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "v int, g int")
    assert [r["v"] for r in files.numbered(rows, "v").orderBy("rn").collect()] == list(range(50))
    assert {r["rn"] for r in files.numbered(rows, "v", "g").where("g = 1").collect()} == set(range(1, 18))


def test_trees_of_any_depth(spark):
    node = {"title": "t20", "line_num": 20, "summary": "é" * 200}
    for i in range(19, -1, -1):
        node = {"title": f"t{i}", "line_num": i, "nodes": [node]}
    roots = spark.createDataFrame([("b", json.dumps([node]))], "book string, nodes string")
    flat = tree.flatten_tree(roots, "book", "nodes")
    rows = flat.orderBy("depth").collect()
    assert [(r["depth"], r["line_num"]) for r in rows] == [(i, i) for i in range(21)]
    chapters = tree.level_one(flat)
    assert [(r["chapter"], r["title"]) for r in chapters.collect()] == [("0000.0000", "t1")]
    assert sorted(r["line_num"] for r in tree.subtree_lines(flat, chapters).collect()) == list(range(2, 21))
    assert flat.where("depth = 20").select(tree.summary(F.col("summary"))).first()[0] == "é" * 125
    deep = spark.createDataFrame([("b", i, i + 1) for i in range(9)], "book string, line int, level int")
    assert [r["parent"] for r in tree.headings_tree(deep, "book", "line", "level").orderBy("line").collect()] == [None, *range(8)]


def test_pdf_text_and_glossary(spark, tmp_path):
    stream = zlib.compress(b"BT (Mursal : a report) Tj ET BT [(no) -5 (te)] TJ ET BT (Aziz: two \\(or more\\)) Tj ET")
    data = b"%PDF-1.4\n1 0 obj << /Length 9 >>\nstream\n" + stream + b"\nendstream\nstream\nBT (Mursal: other) Tj ET\nendstream\n"
    (tmp_path / "a.pdf").write_bytes(data)
    text = files.read_pdf(spark, str(tmp_path / "a.pdf"))
    assert text.first()["text"] == "Mursal : a report\nnote\nAziz: two (or more)\nMursal: other"
    assert {r["term"]: r["meaning"] for r in files.glossary(text).collect()} == {"Mursal": "a report", "Aziz": "two (or more)"}


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            path, _, rest_ = self.path.partition("?")
            if path == "/counts":
                body = {"2:1": 3, "2:2": 1, "x": 5}
            elif path == "/page":
                n = int(rest_)
                body = {} if n == 3 else {"text": f"page {n}"}
            elif path == "/file.csv":
                body = None
            else:
                page = int(rest_)
                body = {"page": page, "has_more": page < 4}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"a,b\n1,2\n" if body is None else json.dumps(body).encode())

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_remote_sources(spark, tmp_path, server):
    url, asked = server
    spark.dataSource.register(rest.RestSource)
    read = lambda **o: spark.read.format("paged_rest").options(pauseSeconds="0", **o).load()
    paged = dict(url=url + "/{key}?{page}", keys="k", firstPage="2", cache=str(tmp_path / "cache"))
    assert [r["page"] for r in read(**paged).orderBy("page").collect()] == [2, 3, 4]
    before = len(asked)
    assert read(**paged).count() == 3 and len(asked) == before
    with pytest.raises(Exception, match="more than 2 pages"):
        read(**{**paged, "cache": str(tmp_path / "none"), "mostPages": "2"}).collect()
    counts = rest.range_counts(read(url=url + "/counts", keys="2"))
    assert sorted(map(tuple, counts.collect())) == [(2, 1, 3), (2, 2, 1)]
    path = str(tmp_path / "pages")
    assert rest.fetch_missing(spark, url + "/page?{key}", 5, path, chunk=2, pauseSeconds="0") == 5
    assert sorted(r["page"] for r in spark.read.parquet(path).collect()) == [1, 2, 4, 5]
    assert rest.fetch_missing(spark, url + "/page?{key}", 6, path, pauseSeconds="0") == 2
    for _ in range(2):
        rows = files.read_remote(spark, url + "/file.csv", str(tmp_path / "landing"), lambda s, p: files.read_csv_strict(s, p, "a int, b int"))
        assert tuple(rows.first()) == (1, 2)
    assert sum(x == "/file.csv" for x in asked) == 1


def test_sinks_that_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", "5" if i % 2 else "x", "g" if i else None) for i in range(50)], "id long, text string, n string, grp string")
    at = lambda name: str(tmp_path / name)
    assert sinks.load_once(spark, at("once"), rows) and not sinks.load_once(spark, at("once"), rows)
    sinks.create(rows.where("id < 10"), at("made"), "id")
    sinks.create(rows.where("id < 20").unionAll(rows.where("id = 15")), at("made"), "id")
    assert sorted(r["id"] for r in spark.read.parquet(at("made")).collect()) == list(range(20))
    edges = spark.createDataFrame([(1, 2, "x"), (1, 99, "y"), (98, 2, "z")], "src long, dst long, kind string")
    dangling = sinks.relate(edges, rows, rows, at("edges"))
    assert {r["kind"] for r in dangling.collect()} == {"y", "z"} and [r["kind"] for r in spark.read.parquet(at("edges")).collect()] == ["x"]
    sinks.delete_where(at("made"), at("rest"), spark, F.col("id") < 15)
    assert spark.read.parquet(at("rest")).count() == 5
    sinks.delete_where(at("made"), at("empty"), spark)
    assert spark.read.parquet(at("empty")).count() == 0
    assert sinks.write_batches(rows, at("batches"), "id", 10) == 5 and sinks.write_batches(rows, at("batches"), "id", 10) == 0
    assert sorted(r["id"] for r in spark.read.parquet(at("batches")).collect()) == list(range(50))
    sinks.write_groups(rows, at("groups"), "grp", ("n",))
    back = spark.read.json(at("groups"))
    assert back.count() == 49 and {r["n"] for r in back.collect()} == {5, None}
    sinks.write_split_jsonl(rows.select("id", "text"), at("split"), "id")
    ids = [json.loads(x)["id"] for p in sorted((tmp_path / "split").glob("split=train/*.json")) for x in p.read_text().splitlines()]
    assert ids != sorted(ids) and len(ids) > 30
    notes = sinks.notes_json(rows.where("id < 3").select("grp", "id", "text"), "grp", "id")
    assert json.loads(notes.where("grp = 'g'").first()["json"]) == [{"id": 1, "text": "t1"}, {"id": 2, "text": "t2"}]


def test_translation_goes_on_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"name {i}" if i % 9 else " ") for i in range(100)], "id long, text string")

    def model(prompt):
        if "name 50" in prompt:
            raise TimeoutError
        return "\n".join(("x" * 300 if "name 7" in line else f"{line} pbuh") for line in prompt.splitlines()) + "\n\n"

    out = {r["id"]: r["translated"] for r in rag.translate(rows.repartition(1), "id", "text", model).collect()}
    assert out[1] == "name 1 ﷺ" and 7 not in out and 50 not in out and 0 not in out
    path = str(tmp_path / "done")
    assert rag.translate_pending(rows.where("id < 40"), "id", "text", model, path, 20) == 2
    first = spark.read.parquet(path).count()
    assert first == sum(i % 9 > 0 and "name 7" not in f"name {i}" for i in range(40))
    rag.translate_pending(rows.where("id < 45"), "id", "text", model, path, 20)
    ids = [r["id"] for r in spark.read.parquet(path).collect()]
    assert len(ids) == len(set(ids)) == first + 5


def test_classified_questions_are_routed(spark):
    asked = spark.createDataFrame([(1, "hadith", "who is Ali?"), (2, "quran", "who is Ali?"), (3, "both", "broken"), (4, "hadith", "who is Nobody?")], "id long, scope string, question string")

    def model(prompt):
        if "broken" in prompt:
            raise ValueError
        return json.dumps({"intent": "narrator_info", "name": prompt.rsplit("is ", 1)[1][:-1]})

    people = spark.createDataFrame([("Ali", 7), ("Ali", 3)], "name string, node long")
    for m, want in ((model, {1: ("narrator_info", 3), 2: ("semantic quran", None), 3: ("semantic both", None), 4: ("semantic hadith", None)}), (None, {i: (f"semantic {s}", None) for i, s in ((1, "hadith"), (2, "quran"), (3, "both"), (4, "hadith"))})):
        got = {r["id"]: (r["plan"], r["node"]) for r in rag.route(rag.classify(asked, m), people).collect()}
        assert got == want


def test_seeds(spark):
    rows = seeds.chapters(spark).orderBy("chapter").collect()
    assert len(rows) == 114 and sum(r["verses"] for r in rows) == 6236 and rows[1]["first"] == 8 and rows[-1]["first"] == 6231
    assert [r["code"] for r in seeds.collections(spark).orderBy("collection").collect()] == ["SB", "SM", "SD", "JT", "SN", "IM"]
    assert {r["kbps"] for r in seeds.reciters(spark).collect()} == {40, 128, 192} and seeds.reciters(spark).count() == 13
    assert sum(r["revelation"] == "Medinan" for r in rows) == 28 and rows[0]["revelation"] == "Meccan"
    assert [r["style"] for r in seeds.reciters(spark).orderBy("reciter").collect()][2:5] == ["Mujawwad", "Murattal", "Teaching"]


def test_chapter_names_come_from_a_file(spark, tmp_path):
    lines = ["chapter,name_ar,name_en,name_latin"] + [f'{i},ا{i},"Name, {i}",n{i}' for i in range(1, 115)]
    (tmp_path / "names.csv").write_text("\n".join(lines), encoding="utf-8")
    names = seeds.read_chapter_names(spark, str(tmp_path / "names.csv"))
    rows = seeds.chapters(spark, names).orderBy("chapter").collect()
    assert rows[113]["name_en"] == "Name, 114" and rows[1]["revelation"] == "Medinan"
    (tmp_path / "few.csv").write_text("\n".join(lines[:-1]), encoding="utf-8")
    with pytest.raises(ValueError):
        seeds.read_chapter_names(spark, str(tmp_path / "few.csv"))


def test_analysis_is_stored(spark, tmp_path):
    chains = spark.createDataFrame([(10, 1, 1, 3, 0), (10, 1, 2, 2, 1), (11, 1, 3, 3, 0), (11, 1, 2, 2, 1), (12, 2, 9, 1, 0)], "variant long, family long, node long, gen int, pos int")
    out = structure.analyse_families(chains, graph.chain_edges(chains), str(tmp_path))
    assert {r["family"] for r in out["families"].collect()} == {1} and out["chains"].count() == 2 and out["pivots"].count() > 0
    assert spark.read.parquet(str(tmp_path / "pivots")).count() == out["pivots"].count()


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "a int, b int")
    got = order.numbered(rows.repartition(5), "place", F.desc("a")).collect()
    assert all(r["place"] == 101 - r["a"] for r in got)


class Bare:
    """A session on a cluster without any setting, as far as the folder is looked for."""

    master = "spark://host:7077"

    def __getattr__(self, name):
        return self if name in ("sparkContext", "conf", "_jsc") else lambda *_: self

    def get(self, key, default=None):
        return default

    def isDefined(self):
        return False


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Bare())


def test_queries_bring_the_repository_to_their_workers(spark):
    import __spark_entry__

    __spark_entry__.queries()["distinct_tags"](spark, "/root/testdata/sf0.001")
    path = spark.sparkContext.environment["PYTHONPATH"].split(":")
    assert path[0] == __spark_entry__.__file__.rsplit("/", 1)[0]
