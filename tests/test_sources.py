"""Readers, writers and streams on files made for the test."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks
from tessera.sources.rest import RestReader
from tessera.streaming import events


def put(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False))
    return str(path)


def test_graph_json(spark, tmp_path):
    graph = {"narrators": {"hn_1": {"name": "A", "generation": "6?"}}, "hadiths": {"sb_1": {"book": "SB", "refNo": 1, "chain": ["hn_1"], "textEn": ""}}, "bookNames": {"SB": "S"}}
    got = files.read_graph_json(spark, put(tmp_path / "kg.json", graph))
    assert got["narrators"].first()["generation"] == "6?"
    record = got["records"].first()
    assert (record["id"], record["chain"], record["textEn"], record["similar"]) == ("sb_1", ["hn_1"], None, None)
    assert got["books"].collect()[0]["name"] == "S"


def test_csv_modes(spark, tmp_path):
    path = put(tmp_path / "v.csv", 'a,b\n1,"x\ny"\nbad,2\n')
    assert [tuple(r) for r in files.read_csv_lenient(spark, path, "a int, b string").collect()] == [(1, "x\ny")]
    with pytest.raises(Exception):
        files.read_csv_strict(spark, path, "a int, b string").collect()


def test_morphology_and_keyed_json(spark, tmp_path):
    rows = files.read_morphology(spark, put(tmp_path / "m.txt", "# note\n1:1:1:1\tb\tP\tPREF|LEM:b\n1:1:1\tbad\tx\ty\nshort\n")).collect()
    assert [(r["surah"], r["segment"], r["features"]) for r in rows] == [(1, 1, "PREF|LEM:b")]
    assert files.read_keyed_json(spark, put(tmp_path / "k.json", {"1:1": "x"})).first()["value"] == "x"
    assert files.read_keyed_json(spark, str(tmp_path / "none.json")).collect() == []


def test_pages_and_mappings(spark, tmp_path):
    pages = [{"page_id": 1, "meta": {"page": "3", "vol": "1", "headings": ["h"]}, "text": "t"}, {"page_id": 2, "meta": '{"page":"4","vol":"1"}', "text": "u"}]
    rows = files.read_pages(spark, put(tmp_path / "p.json", pages), 7).orderBy("page_index").collect()
    assert [(r["book_id"], r["page_index"], r["page_num"], r["text"]) for r in rows] == [(7, 0, "3", "t"), (7, 1, "4", "u")]
    mapping = {"2:255": {"page": 10}, "0:1": {"page": 3}, "12": {"page_index": 4}, "x:y": {"page": 1}}
    rows = files.read_mapping(spark, put(tmp_path / "m.json", mapping), one_based=True).collect()
    assert sorted((r["a"], r["b"] or 0, r["page_index"]) for r in rows) == [(2, 255, 9), (12, 0, 4)]
    phrases = {"7": {"count": 2, "ayah": {"1:2": [[1, 3], [4]], "bad": [[1, 2]]}}}
    ranges, skipped = files.read_phrases(spark, put(tmp_path / "ph.json", phrases))
    assert [tuple(r) for r in ranges.collect()] == [("7", "1_2", 1, 3)] and skipped.first()["skipped"] == 2


def test_triples_and_lists(spark, tmp_path):
    text = "<a> <follows> <b> .\n<b> <follows> <c> .\n<x> <label> \"a \\\"q\\\" b\"@en .\nnot a triple\n"
    rows = files.read_triples(spark, put(tmp_path / "t.nt", text))
    assert {(r["s"], r["p"], r["o"]) for r in rows.collect()} == {("a", "follows", "b"), ("b", "follows", "c"), ("x", "label", 'a \\"q\\" b')}
    chain = files.follow_chain(rows, "follows").orderBy("pos").collect()
    assert [(r["head"], r["node"], r["pos"]) for r in chain] == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_rest_pages_and_retries(monkeypatch):
    reader = RestReader({"url": "http://x/{key}/{page}", "keys": "a,b,c", "partitions": "2", "pauseSeconds": "0"})
    assert sorted(k for p in reader.partitions() for k in p.keys) == ["a", "b", "c"]
    monkeypatch.setattr(reader, "_get", lambda url: {"url": url, "has_more": url.endswith("/1")})
    assert [(k, p) for k, p, _ in reader.read(reader.partitions()[0])] == [("a", 1), ("a", 2), ("c", 1), ("c", 2)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string")
    sinks.write_split_jsonl(rows, str(tmp_path / "j"), "id")
    back = spark.read.json(str(tmp_path / "j"))
    assert back.count() == 50 and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "valid"}
    new = spark.createDataFrame([(1, "new"), (99, "more"), (2, None)], "id long, text string")
    got = {r["id"]: r["text"] for r in sinks.upsert(rows, new, "id").collect()}
    assert got[1] == "new" and got[2] == "t2" and got[99] == "more" and len(got) == 51
    assert sinks.pending(rows, new, "id", F.col("id"), 10).count() == 9
    assert [r["rows"] for r in sinks.check_unique(rows.unionAll(rows.where("id = 3")), "id").collect()] == [2]
    parts = rows.withColumn("p", F.col("id") % 2)
    sinks.overwrite_partitions(parts, str(tmp_path / "o"), "p")
    sinks.overwrite_partitions(parts.where("id = 1"), str(tmp_path / "o"), "p")
    assert spark.read.parquet(str(tmp_path / "o")).count() == 26
    sinks.write_groups(parts, str(tmp_path / "g"), "p")
    heads = spark.createDataFrame([("b", 1, "T", 1), ("b", 3, "U", 9)], "book string, at long, title string, level int")
    text = spark.createDataFrame([("b", 1, "x")], "book string, at long, text string")
    assert sinks.markdown(heads, text, "book", "at").first()["markdown"] == "## T\n\nx\n\n###### U"


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stored = {}

    def keep(batch, n):
        for r in batch.collect():
            stored[r["event_type"]] = r["n"]

    stream = events.read_events(spark, str(tmp_path / "in"), source.schema)
    events.run_available(events.counters(stream, ["event_type"]), str(tmp_path / "c1"), keep).awaitTermination(120)
    assert stored == {r["event_type"]: r["count"] for r in source.groupBy("event_type").count().collect()}
    states = {}

    def last(batch, n):
        for r in batch.collect():
            states[r["user_id"]] = r["event_id"]

    events.run_available(events.last_states(stream, ["user_id"], "ts", "event_id"), str(tmp_path / "c2"), last).awaitTermination(120)
    want = source.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e")).collect()
    assert states == {r["user_id"]: r["e"] for r in want}
    first = []
    events.run_available(events.first_in_ttl(stream, ["user_id", "event_type"]), str(tmp_path / "c3"), lambda b, n: first.extend(b.collect()), "append").awaitTermination(120)
    assert len(first) >= source.select("user_id", "event_type").distinct().count()
    assert events.windowed_counts(stream, "event_type").isStreaming
