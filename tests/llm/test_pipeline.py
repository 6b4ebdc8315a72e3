"""The pipeline's stages: on the smallest tables, on odd rows and on none, each against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tessera.llm import packing, quality, toxicity
from tessera.llm.queries import QUERIES
from tests.llm.test_native import brute_targets
from tests.llm.test_texts import ODD, brute_join, shingle_set

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        rows = out.collect()
        got = {r["doc_id"] for r in rows}
        assert got <= ids and len(got) > 0.5 * len(ids), name
        docs, ids = spark.createDataFrame(rows, docs.schema), got
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_queries_name_every_operator():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))


@pytest.fixture(scope="module")
def docs(spark):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10_000 + i, t, "en", None if i % 3 else "src1", len(t or "")) for i, t in enumerate(ODD)]
    odd += [(None, "no id at all but words", "en", "src1", 22), (3, "another text of a known id", None, "src2", 26), (10_000, None, None, None, None)]
    return small.unionByName(spark.createDataFrame(odd, SCHEMA))


def as_set(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows_give_no_rows(spark, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = STAGES[name](spark, empty, SF)
    assert out.collect() == []
    if name != "packing":
        assert out.columns == empty.columns


@pytest.mark.parametrize("name,module,label", [("toxicity", toxicity, "toxic"), ("quality", quality, "quality")])
def test_filters_follow_their_scores(spark, docs, name, module, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    texts = pa.array([r["text"] for r in rows])
    if label == "toxic":
        bad = module.toxicity_model(docs, labels, toxicity.learning_rows()).load().score(texts) >= 0.5
    else:
        bad = module.quality_model(docs, labels, toxicity.learning_rows()).load().score(quality.text_statistics(texts)) < 0.3
    want = [r for r, b in zip(rows, bad) if not b]
    assert as_set(STAGES[name](spark, docs, SF).collect()) == as_set(want)


def test_near_copies_keep_the_least_of_each_group(spark, docs):
    rows = [r for r in docs.collect() if r["doc_id"] is None or r["doc_id"] != 3 and r["doc_id"] != 10_000]
    some = spark.createDataFrame(rows, SCHEMA)
    named = sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    kept = {named[i]["doc_id"] for i, *_, k in brute_join([r["text"] for r in named]) if k}
    got = STAGES["near_copies"](spark, some, SF).collect()
    assert as_set(got) == as_set([r for r in rows if r["doc_id"] is None or r["doc_id"] in kept])
    assert shingle_set("") == set()


def test_mixing_takes_what_the_targets_say(spark, docs):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    want = {k: int(round(v, 6)) for k, v in brute_targets(sizes).items()}
    got, texts = {}, {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in STAGES["mixing"](spark, docs, SF).collect():
        got[r["source"]] = got.get(r["source"], 0) + len(WORD.findall(r["text"]))
        assert any(t.startswith(r["text"]) for t in texts[r["doc_id"]])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_packing_gives_every_identifier_back(spark, docs):
    encode = packing.public_byte_bpe().encoder()
    want = sorted(np.append(encode(r["text"] or ""), 0).astype("<u4").tobytes() for r in docs.collect())
    rows = STAGES["packing"](spark, docs, SF).orderBy("sequence_id").collect()
    out, held = [], []
    for p in rows:
        held.append(p["ids"])
        if p["start"] + p["length"] == p["doc_tokens"]:
            out.append(b"".join(held))
            held = []
    assert sorted(map(bytes, out)) == want and not held


def test_read_stages_are_removed(spark, tmp_path, monkeypatch):
    from tessera.llm import session

    made = []
    monkeypatch.setattr(session, "scratch", lambda s, name: made.append(str(tmp_path / name)) or made[-1])
    corpus_pipeline.run(spark, SF).count()
    assert [p for p in made if (tmp_path / p).exists()] == made[-1:]


def test_sequences_follow_the_order_of_training(spark, docs, tmp_path):
    """Through a write and a read, with files of different sizes, whose order Spark's reader doesn't keep."""
    rows = spark.createDataFrame([r for r in docs.collect() if r["doc_id"] is not None], SCHEMA)
    mixed = STAGES["mixing"](spark, rows, SF)
    mixed.write.option("maxRecordsPerFile", 37).parquet(str(tmp_path / "mixed"))
    packed = STAGES["packing"](spark, spark.read.parquet(str(tmp_path / "mixed")), SF)
    got = packed.orderBy("sequence_id").collect()
    assert len({p["sequence_id"] for p in got}) == len(got)
    assert [p["doc_id"] for p in got if p["start"] == 0] == [r["doc_id"] for r in mixed.collect()]
    for a, b in zip(got, got[1:]):
        assert b["start"] in (0, a["start"] + a["length"])


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "x" * 1_000_000, "a \t" * 200_000, "word " + " " * 600_000 + "end"])
def test_long_texts_are_packed_and_counted(spark, text):
    from tessera.llm import tokencount

    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "short", "en", "s", 5)], SCHEMA)
    slow = packing.TokenizerFiles(packing.public_byte_bpe().json_path).encoder()
    want = slow(text).tolist() + [0]
    pieces = STAGES["packing"](spark, docs, SF).where("doc_id = 1").orderBy("sequence_id").collect()
    assert np.frombuffer(b"".join(bytes(p["ids"]) for p in pieces), dtype="<u4").tolist() == want
    stream = tokencount.token_stream(docs, packing.public_byte_bpe(), end_id=50256)
    counted = {r["doc_id"]: r["tokens"] for r in tokencount.count_tokens(stream, end_id=50256).collect()}
    assert counted == {1: len(want) - 1, 2: len(slow("short"))}
