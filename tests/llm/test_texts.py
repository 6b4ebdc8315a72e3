"""Operators on texts and vectors against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import embeddings, jaccard, lmscore, packing, quality, textscan, tokencount, toxicity
from tessera.llm.session import held_out

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", " ", "a", "\n\t", "Ünï code space 😀😀", "<|endoftext|> in <|endoftext|>text", "x" * 5000, "the " * 3000,
    "line\nline\nline", "tab\tx\x0bv\x0cf\rr", "!!! ??", "日本語 テキスト", "\x00nul\x00 ", "don't we'll  I'M", "á é",
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, label int, component string, n int")


def as_rows(texts, first=0):
    return [(i, t, "s", 1, 0, "c", 2) for i, t in enumerate(texts, first)]


def words(text):
    return SPLIT.findall((text or "").translate(FOLD))


def test_scan_finds_words_and_hashes_them():
    texts = ODD + ["Alpha beta ALPHA"]
    counts, by_word = [], {}
    for most in (1, 64, 1 << 22):
        counts = []
        for s in textscan.scan(pa.array(texts), most=most):
            counts += s.counts().tolist()
            for d, i, j, h in zip(s.doc, s.start, s.end, s.hashes()):
                word = bytes(s.low[i:j]).decode()
                assert by_word.setdefault(word, h) == h
        assert counts == [len(words(t)) for t in texts]
    assert len(set(by_word.values())) == len(by_word)
    assert set(by_word) == {w for t in texts for w in words(t)}


def test_shingles_of_short_and_long_texts():
    texts = ["", "a b", "a b c d e", "a b c d e f", None, "z a b c d e"]
    s = next(textscan.scan(pa.array(texts)))
    values, at = textscan.shingles(s.hashes(), s.first, 5)
    assert np.diff(at).tolist() == [0, 1, 1, 2, 0, 2]
    sets = [set(values[i:j].tolist()) for i, j in zip(at[:-1], at[1:])]
    assert sets[2] < sets[3] and sets[2] & sets[5] == sets[2] and not sets[1] & sets[2]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    files = packing.public_byte_bpe()
    slow = Tokenizer.from_file(files.json_path)
    rng = random.Random(2)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), 32])) for _ in range(200)) for _ in range(40)]
    rows = as_rows(texts) + [(None, "no id", "s", 1, 0, "c", 2), (3, "a", "s", 1, 0, "c", 2)]
    pieces = packing.pack_documents(frame(spark, rows), files).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    got = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"])):
        assert p["length"] == 1 << p["bucket"] <= 1024 and p["offset"] == 0 and len(p["ids"]) == 4 * p["length"]
        got.setdefault(p["doc_id"], []).append(p)
    assert len(got[3]) == 2 * len(packing.piece_lengths(got[3][0]["doc_tokens"], 1024))
    for i, text in enumerate(texts):
        if i == 3:
            continue
        want = slow.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(got[i], key=lambda p: p["start"])
        assert [p["start"] for p in parts] == np.cumsum([0] + [p["length"] for p in parts])[:-1].tolist()
        assert np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() == want
        digest = packing.packing_digest(spark.createDataFrame(parts, packing_schema())).orderBy("start").collect()
        assert [d["ids_crc32"] for d in digest] == [zlib.crc32(p["ids"]) for p in parts]
    assert packing.pack_documents(frame(spark, []), files).collect() == []
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark, rows), files, 1000)


def packing_schema():
    return "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary, sequence_id long, offset long"


def test_token_counts_across_blocks(spark, tmp_path):
    rng = random.Random(5)
    lengths = [rng.choice([0, 1, 2, 30, 200]) for _ in range(60)]
    flat = []
    for n in lengths:
        flat += [rng.randrange(1, 100) for _ in range(n)] + [0]
    flat += [7, 7]
    np.array(flat, dtype="<u2").tofile(tmp_path / "a.bin")
    np.array([0, 0], dtype="<u2").tofile(tmp_path / "b.bin")
    blocks = tokencount.read_token_files(spark, str(tmp_path), 2, block_tokens=16)
    rows = tokencount.count_tokens(blocks, 0, 2, block_tokens=16).collect()
    a = sorted((r for r in rows if r["file"].endswith("a.bin")), key=lambda r: r["ordinal"])
    assert [r["tokens"] for r in a] == lengths + [2]
    assert [r["closed"] for r in a] == [True] * len(lengths) + [False]
    assert [r["start"] for r in a] == [0, *np.cumsum(np.array(lengths) + 1).tolist()]
    assert [r["tokens"] for r in rows if r["file"].endswith("b.bin")] == [0, 0]


def test_token_stream_keeps_documents(spark):
    files = packing.public_byte_bpe()
    rows = as_rows(ODD)
    encode = files.encoder(special_as_text=True)
    stream = tokencount.token_stream(frame(spark, rows), files, 50256, block_tokens=64)
    got = {r["doc_id"]: r["tokens"] for r in tokencount.count_tokens(stream, 50256, block_tokens=64).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(ODD)}
    assert tokencount.count_tokens(tokencount.token_stream(frame(spark, []), files, 50256), 50256).collect() == []


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(20, 200))
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t))
    texts += [" ".join(shared + rng.choices(vocabulary, k=rng.randrange(30, 120))) for _ in range(20)]
    big = rng.choices(vocabulary, k=120)
    for _ in range(150):  # more near copies than a small bucket holds
        t = list(big)
        t[rng.randrange(120)] = rng.choice(vocabulary)
        texts.append(" ".join(t))
    return texts + [None, "", "one two", "ONE two", texts[0], texts[0].upper()]


def brute_join(texts, threshold=0.8):
    sets = [frozenset(shingle_set(t)) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    reps = sorted(first.values())
    links = {i: set() for i in reps}
    for x in reps:
        for y in reps:
            if x < y and sets[x] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]) - 1e-9:
                links[x].add(y)
                links[y].add(x)
    component = {}
    for i in reps:
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += links[j]
    return [(i, first[s], sum(1 for x in sets if x == s), len(links[first[s]]), component[first[s]], component[first[s]] == i) for i, s in enumerate(sets)]


@pytest.mark.parametrize("chunk", [512, 40])
def test_jaccard_join_equals_brute_force(spark, chunk):
    texts = near_texts(chunk)
    got = jaccard.jaccard_join(frame(spark, as_rows(texts)), chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == brute_join(texts)


def test_jaccard_runs_follow_depth(spark, monkeypatch):
    runs, paths = [], jaccard.chosen_paths
    monkeypatch.setattr(jaccard, "chosen_paths", lambda classes, more, *a: runs.append(more) or paths(classes, more, *a))
    rng = random.Random(5)
    passage, texts = [f"p{i}" for i in range(110)], []
    for i in range(300):
        own = [f"u{i}x{j}" for j in range(70)]
        other = own[:20] + [f"v{i}x{j}" for j in range(15)] + own[35:]
        texts += [" ".join(passage + own), " ".join(passage + other)]
    want = {(2 * i, 2 * i + 1) for i in range(300)}
    sets = [shingle_set(t) for t in texts]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in want)
    rows = as_rows(texts)
    rng.shuffle(rows)
    got = jaccard.jaccard_join(frame(spark, rows), small=2, dense=1.0, most_levels=9).where("not kept").collect()
    found = {(r["component_id"], r["doc_id"]) for r in got}
    assert found <= want and len(found) >= 0.99 * len(want), len(found)
    assert list(runs[0]) == list(range(1, 9)) and sum(map(len, runs)) == jaccard.runs_needed(9, 0.8, 0.99, 64)


def test_jaccard_runs_needed():
    needed = [jaccard.runs_needed(d, 0.8, 0.99, 64) for d in (1, 5, 11, 16)]
    assert needed == sorted(needed) and needed[1] <= 8 < needed[2]


def test_jaccard_odd_inputs(spark):
    rows = as_rows(["a b c d e f g", "a b c d e f g"]) + [(None, "a b c d e f g", "s", 1, 0, "c", 2)] * 2 + [(0, "a b c d e f g", "s", 1, 0, "c", 2)]
    got = jaccard.keep_one_of_each(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["0", "None", "None"]
    assert jaccard.jaccard_join(frame(spark, [])).collect() == []


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 1, 2, 5, 40, 130):
        centre = rng.standard_normal(16)
        rows += [centre + rng.standard_normal(16) * 0.06 for _ in range(size)]
    rows += list(rng.standard_normal((60, 16)))
    rows.append(rows[5] * 3)
    x = [r.astype(np.float32).tolist() for r in rows]
    x += [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [], [float("inf")] + [0.0] * 15, [1.0, 0.0], [1e30] * 16, [1e-30] * 16]
    vectors = spark.createDataFrame([(i, v, 0, "x") for i, v in enumerate(x)] + [(None, x[0], 0, "x")], "vec_id long, embedding array<float>, size int, unit string")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors, window=32, chunk=50).collect()}
    assert len(got) == len(x) + 1
    usable = {}
    for i, v in enumerate(x):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            d = np.array(v, dtype=np.float64)
            usable[i] = d / np.linalg.norm(d)
    links = {i: {j for j, b in usable.items() if j != i and len(a) == len(b) and a @ b >= 0.95} for i, a in usable.items()}
    for i in range(len(x)):
        reach, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, ())), min(reach), i == min(reach)), i
    assert embeddings.near_duplicates(vectors.limit(0)).collect() == []


def crowd(n, pairs, seed):
    """Unit vectors of mutual cosine 0.9 about one direction, some of them with a partner at cosine 0.951."""
    rng = np.random.default_rng(seed)
    centre = np.zeros(300)
    centre[0] = 1
    x = rng.standard_normal((n, 300))
    x[:, 0] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, 300))
    y[:, 0] = 0
    y -= (y * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.51 * x[:pairs] + np.sqrt(1 - 0.51**2) * y
    return np.sqrt(0.9) * centre + np.sqrt(0.1) * np.concatenate([x, y])


def test_embeddings_of_a_crowd_are_all_linked(spark):
    x = crowd(2500, 300, 1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(vectors, window=32).collect()}
    linked = x @ x.T >= 0.95
    assert linked[np.arange(300), np.arange(2500, 2800)].all() and linked.sum() == 2800 + 600
    assert got == {i: (int(linked[i].sum()) - 1, int(np.flatnonzero(linked[i]).min())) for i in range(len(x))}


def test_bucket_passes_reach_their_recall(spark):
    x = crowd(1500, 300, 2)
    rows = spark.createDataFrame([(i, bytearray(v.tobytes()), i) for i, v in enumerate(x)], "vec_id long, unit binary, component long")
    passes = embeddings.passes_for(8, 0.95, 0.9999)
    assert passes == 17
    got = {tuple(sorted(r)) for r in embeddings.bucket_links(rows, 0.95, 8, passes, 100, 1).collect()}
    assert got == {(i, 1500 + i) for i in range(300)}


@pytest.mark.parametrize("order,block_bytes", [(1, 300), (2, 400), (3, 1 << 20)])
def test_language_model_equals_brute_force(spark, order, block_bytes):
    rng = random.Random(order)
    texts = [" ".join(rng.choices(["the", "The", "of", "a", *(f"w{i}" for i in range(40))], k=rng.randrange(0, 25))) for _ in range(60)] + [None, "", "only here"]
    texts[5] = texts[7]
    rows = as_rows(texts)
    got = {r["doc_id"]: r for r in lmscore.language_model_scores(frame(spark, rows), held_out(F.col("doc_id"), 7, 2), order, 5.0, block_bytes).collect()}
    assert len(got) == len(texts)
    tokens = [words(t) + [END] for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter()
    for i in train:
        seq = [BEGIN, *tokens[i]]
        count[BEGIN,] += 1
        for j in range(1, len(seq)):
            for k in range(1, order + 1):
                if j - k + 1 >= 0:
                    count[tuple(seq[j - k + 1 : j + 1])] += 1
    unigrams = {k[0]: v for k, v in count.items() if len(k) == 1 and k[0] != BEGIN}
    n, v = sum(unigrams.values()), len(unigrams)
    ones, twos = (sum(x == c for x in unigrams.values()) for c in (1, 2))
    discount = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5
    for i, own in enumerate(tokens):
        seq, base, score = [BEGIN, *own], 0.0, 0.0
        for j in range(1, len(seq)):
            c = unigrams.get(seq[j], 0)
            base += math.log10((c + 1) / (n + v + 1))
            p = (max(c - discount, 0) + discount * v / (v + 1)) / n
            for k in range(2, order + 1):
                if j - k + 1 >= 0 and count[tuple(seq[j - k + 1 : j])]:
                    p = (count[tuple(seq[j - k + 1 : j + 1])] + 5 * p) / (count[tuple(seq[j - k + 1 : j])] + 5)
            score += math.log10(p)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in unigrams for w in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert r["held_out"] == (i not in train)


BEGIN, END = "<begin>", "<end>"


def test_language_model_of_nothing(spark):
    assert lmscore.language_model_scores(frame(spark, []), F.lit(False)).collect() == []
    out = lmscore.language_model_scores(frame(spark, as_rows(["a b"])), F.lit(True)).collect()
    assert out[0]["score"] == 0 and out[0]["train_tokens"] == 0


def labelled(spark, texts, labels, kind):
    table = spark.createDataFrame([(i, int(y), "x") for i, y in enumerate(labels)], f"doc_id long, {kind} int, text string")
    return frame(spark, as_rows(texts)), table


def test_toxicity_learns_and_filters(spark):
    rng = random.Random(8)
    plain = [f"v{i}" for i in range(400)]
    texts, labels = [], []
    for i in range(400):
        t, bad = rng.choices(plain, k=rng.randrange(20, 80)), i % 5 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["dolt", "oaf", "lout"]))
        texts.append(" ".join(t))
        labels.append(bad)
    docs, table = labelled(spark, texts, labels, "toxic")
    out = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, table, toxicity.learning_rows()).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((out[i] >= 0.5) == labels[i] for i in held)
    kept = toxicity.drop_toxic(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in out if out[i] < 0.5}


def test_quality_learns_and_filters(spark):
    rng = random.Random(9)
    plain = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choices(plain, k=rng.randrange(20, 80))) for _ in range(300)]
    labels = [i % 4 != 0 for i in range(300)]
    texts = [t if y else t.upper().replace(" ", "!! ") for t, y in zip(texts, labels)]
    docs, table = labelled(spark, texts, labels, "quality")
    out = {r["doc_id"]: r["score"] for r in quality.quality(docs, table, toxicity.learning_rows()).collect()}
    assert all((out[i] >= 0.3) == labels[i] for i in range(300))
    kept = quality.drop_low_quality(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(labels)


@pytest.mark.parametrize("score,kind", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_odd_inputs(spark, score, kind):
    docs, table = labelled(spark, ODD, [i % 2 for i in range(len(ODD))], kind)
    out = score(docs, table).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert len(score(docs, table.limit(0)).collect()) == len(ODD)
    assert len(score(docs, table.where(f"{kind} = 1")).collect()) == len(ODD)
    assert score(docs.limit(0), table).collect() == []


@pytest.mark.parametrize("stage,kind", [(toxicity.drop_toxic, "toxic"), (quality.drop_low_quality, "quality")])
def test_filters_without_a_model_keep_every_row(spark, stage, kind):
    docs, table = labelled(spark, ODD, [i % 2 for i in range(len(ODD))], kind)
    for labels in (table.limit(0), table.where(f"{kind} = 0"), table.where(f"{kind} = 1")):
        assert stage(docs, labels).count() == len(ODD)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    trees = quality.fit_trees(x, y, np.ones(500), rounds=20)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95

    def descend(root, row):
        node = root
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    want = [trees.base + sum(descend(r, row) for r in trees.roots) for row in x[:50]]
    assert np.allclose(trees.raw(x[:50]), want)
