"""Files of one JSON object or list, read by several tasks, against Python's parser."""

import json
import random

import pytest

from tessera.sources import files, split_json


def text(rng, n=30):
    return "".join(rng.choice(['{', '}', '"', "\\", "a", "é", " ", ":", ",", "\n", "[", "]", "}}", '"}']) for _ in range(rng.randrange(n)))


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind == 0:
        return text(rng)
    if kind == 1:
        return rng.choice([None, True, 7, -1.5])
    if kind == 2:
        return [text(rng, 6) for _ in range(rng.randrange(3))]
    return {text(rng, 5) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.fixture()
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_maps_of_objects(spark, small_blocks, tmp_path, indent):
    rng = random.Random(3)
    whole = {f"sec{s}": {f"k{i}" + text(rng, 4): {"f": value(rng), "g": {}} for i in range(rng.randrange(1, 25))} for s in range(4)}
    whole |= {"empty": {}, "names": {text(rng, 6) + str(i): text(rng) for i in range(9)}, "last": {"x": {"y": {"z": {"}": "{"}}}}}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=indent is None), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"sec0": {"other": {"f": 1}}}) + "\n")
    assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 3
    entries, maps = split_json.read_maps(spark, str(tmp_path))
    got = {(r["file"].rsplit("/")[-1], r["section"], r["id"]): json.loads(r["value"]) for r in entries.collect()}
    want = {("a.json", s, i): v for s, m in whole.items() for i, v in m.items() if isinstance(v, dict)} | {("b.json", "sec0", "other"): {"f": 1}}
    assert got == want
    assert {r["section"]: json.loads(r["value"]) for r in maps.collect()} == {"names": whole["names"], "empty": {}}


@pytest.mark.parametrize("indent", [None, 1])
def test_lists_of_objects(spark, small_blocks, tmp_path, indent):
    rng = random.Random(4)
    whole = [{"a": value(rng), "b": text(rng)} for _ in range(70)] + [{}]
    (tmp_path / "l.json").write_text(json.dumps(whole, indent=indent))
    got = sorted((r["place"], r["value"]) for r in split_json.read_list(spark, str(tmp_path / "l.json")).collect())
    assert [p for p, _ in got] == list(range(71)) and [json.loads(v) for _, v in got] == whole
    (tmp_path / "none.json").write_text("[]")
    assert split_json.read_list(spark, str(tmp_path / "none.json")).collect() == []


def test_graph_files_in_blocks(spark, small_blocks, tmp_path):
    rng = random.Random(5)
    graph = {
        "narrators": {f"n{i}": {"popularName": text(rng), "generation": str(i % 12)} for i in range(30)},
        "hadiths": {f"h{i}": {"book": "SB", "refNo": i, "chain": [f"n{j}" for j in range(i % 4)], "textEn": "" if i % 3 else text(rng) + "x"} for i in range(30)},
        "bookNames": {"SB": "one {book}", "SM": 'another "}'},
    }
    (tmp_path / "kg.json").write_text(json.dumps(graph, ensure_ascii=False), encoding="utf-8")
    read = files.read_graph_json(spark, str(tmp_path / "kg.json"))
    assert {r["id"]: (r["popularName"], r["generation"]) for r in read["narrators"].collect()} == {k: (v["popularName"], v["generation"]) for k, v in graph["narrators"].items()}
    records = {r["id"]: r for r in read["records"].collect()}
    assert {k: (r["refNo"], r["chain"], r["textEn"]) for k, r in records.items()} == {k: (v["refNo"], v["chain"], v["textEn"] or None) for k, v in graph["hadiths"].items()}
    assert {r["id"]: r["name"] for r in read["books"].collect()} == graph["bookNames"]
