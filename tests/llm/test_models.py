"""Trained models against plain Python: Kneser-Ney pairs, text statistics, the backoff automaton."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lmscore, quality, sampling, textscan, toxicity
from tests.llm.test_texts import ODD, frame

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_features(train, labels, strength, texts):
    """The same models with dictionaries of words and pairs."""
    words = [WORD.findall(lower(t)) for t in train]
    seen = [set(), set()]
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    follows, distinct = Counter(), set()
    for ws, y in zip(words, labels):
        for i, w in enumerate(ws):
            pair = tuple(ws[max(i - 1, 0) : i + 1])
            longer = tuple(ws[max(i - 2, 0) : i + 1])
            if len(pair) == 2 and pair not in distinct:
                distinct.add(pair)
                follows[w] += 1
            if longer not in seen[y]:
                seen[y].add(longer)
                uni[y][w] += 1
                if len(pair) == 2:
                    bi[y][pair] += 1
    vocabulary = sorted(set().union(*map(set, words)))
    total = sum(follows[w] + 0.5 for w in vocabulary)

    def left(counts):
        share = [sum(c.values()) / max(sum(sum(x.values()) for x in counts), 1) for c in counts]
        return [
            {k: max(c.get(k, 0) - 1.5 * s * sum(x.get(k, 0) for x in counts) - strength * math.sqrt(c.get(k, 0)), 0) for k in set(counts[0]) | set(counts[1])}
            for c, s in zip(counts, share)
        ]

    one = left(uni)
    all_uni = sum(sum(c.values()) for c in uni)
    weight = 1 - min(1 - 1e-6, sum(sum(x.values()) for x in one) / max(all_uni, 1))
    unseen = 0.5 / (2 * total)
    low = [{w: (1 - weight) * one[c].get(w, 0) / max(sum(one[c].values()), 1) + weight * (follows[w] + 0.5) / (2 * total) for w in vocabulary} for c in (0, 1)]
    two = left(bi)
    both = {k: bi[0].get(k, 0) + bi[1].get(k, 0) for k in distinct}
    by_context, context_total, pooled_sum = [defaultdict(float), defaultdict(float)], defaultdict(float), defaultdict(float)
    for k, n in both.items():
        context_total[k[0]] += n
        pooled_sum[k[0]] += max(n - 0.75, 0)
        for c in (0, 1):
            by_context[c][k[0]] += two[c].get(k, 0)
    out = []
    for t in texts:
        ws, ratios = WORD.findall(lower(t)), []
        for i, w in enumerate(ws):
            p = []
            for c in (0, 1):
                unigram, back, kept = low[c].get(w, weight * unseen), 1.0, 0.0
                if i and ws[i - 1] in low[0]:
                    a = ws[i - 1]
                    n = max(context_total[a], 1)
                    own = (by_context[0][a] + by_context[1][a]) / n if min(by_context[0][a], by_context[1][a]) > 0 else 0.0
                    back = (1 - own) * (1 - pooled_sum[a] / n)
                    if (a, w) in both:
                        kept = own * two[c].get((a, w), 0) / max(by_context[c][a], 1e-9) + (1 - own) * max(both[a, w] - 0.75, 0) / n
                p.append(kept + back * unigram)
            ratios.append(math.log(p[1] / p[0]))
        n = len(ratios)
        mean = sum(ratios) / max(n, 1)
        window = max([0.0, *(sum(ratios[i : i + 6]) for i in range(n - 5))])
        out.append([10 * mean, mean * math.sqrt(n), math.log1p(n) / 10, max([0.0, *ratios]), window, 1.0])
    return np.array(out)


def test_kneser_ney_pair_equals_brute_force():
    rng = random.Random(4)
    plain, bad = [f"v{i}" for i in range(60)], ["oaf", "lout", "dolt"]
    train, labels = [], []
    for i in range(150):
        ws = rng.choices(plain, k=rng.randrange(0, 30))
        if i % 4 == 0:
            ws += rng.choices(bad, k=3) + ws[:2]
        train.append(" ".join(ws))
        labels.append(int(i % 4 == 0))
    word, doc = toxicity._tokens(pa.array(train))
    model = toxicity.KneserNeyPair.fit(word, doc, np.array(labels)[doc], 1.0)
    texts = [*train[:40], "", "v1", "oaf", "unknown words only here and there", "v1 v2 oaf v3, LOUT! v4 v5 v6"]
    got = np.concatenate([model.difference(s.hashes(), s.doc, s.n) for s in textscan.scan(pa.array(texts), textscan.NON_WORD)])
    assert np.allclose(got, brute_features(train, labels, 1.0, texts), atol=2e-5)
    # nothing of the sample is left out
    assert len(model.words) == len({w for t in train for w in WORD.findall(t)})
    assert len(model.pairs) == len({p for t in train for ws in [WORD.findall(t)] for p in zip(ws, ws[1:])})


def plain_statistics(text):
    data = (text or "").encode()
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    low = [lower(w) for w in words]
    lines = [tuple(lower(w.decode()) for w in re.findall(rb"[^\x20\x09-\x0D]+", x)) for x in data.split(b"\n")]
    lines = [x for x in lines if x]
    size, n = max(len(data), 1), max(len(words), 1)
    classes = quality._CLASSES
    known = set().union(*(set(v) for v in classes.values()))
    shares = [sum(b in v for b in data) / size for v in classes.values()] + [sum(b not in known for b in data) / size]
    length = [len(w.encode()) for w in words]
    return [
        *shares, math.log1p(len(data)), math.log1p(len(words)), sum(length) / n, math.log1p(max(length, default=0)), sum(x <= 3 for x in length) / n,
        len(set(low)) / n, len(set(zip(low, low[1:], low[2:]))) / max(len(words) - 2, 1), max(Counter(low).values(), default=0) / n,
        len(set(lines)) / max(len(lines), 1), math.log1p(len(words) / max(len(lines), 1)), data.count(b"\n") / size, sum(w[0].isascii() and w[0].isupper() for w in words) / n,
    ]


def test_text_statistics_equal_plain_python():
    rng = random.Random(6)
    texts = [*ODD, "a\nb\na\n\nA\n", " ".join(rng.choices(["The", "of", "Ünï", "x1,", "<p>"], k=500)), "one two three " * 40]
    got = quality.text_statistics(pa.array(texts))
    assert got.shape[1] == len(quality.FEATURES)
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-5)


def block(texts, order):
    b = lmscore.block_ngrams(pa.array(texts), np.zeros(len(texts), bool), order)
    counts = [np.bincount(b.index[k][b.train | ((k == 0) & (b.place == 0))], minlength=len(b.keys[k])) for k in range(order)]
    own = counts[0][b.keys[0] != lmscore.BEGIN]
    return b, counts, (own.sum(), (own > 0).sum(), (own == 1).sum(), (own == 2).sum())


@pytest.mark.parametrize("order", [1, 2, 3])
def test_automaton_walks_alike_in_segments(order):
    rng = random.Random(order)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(12)], k=rng.randrange(0, 60))) for _ in range(40)] + ["", "new words w1 w2"]
    b, counts, totals = block(texts, order)
    counts = [np.where(np.random.default_rng(k).random(len(c)) < 0.2, 0, c) if k else c for k, c in enumerate(counts)]  # some n-grams were never trained
    if order == 3:
        # what is longer was seen no more often than its parts
        for k in (1, 2):
            at = np.zeros(len(counts[k]), dtype=int)
            at[b.index[k][::-1]] = np.arange(len(b.doc) - 1, -1, -1)
            counts[k] = np.minimum(counts[k], np.minimum(counts[k - 1][b.index[k - 1][at]], counts[k - 1][b.index[k - 1][at - 1]]))
    machine = lmscore.Automaton.build(b, counts, totals, 5.0)
    whole = lmscore.walk(b, machine, order, 1000)
    for segment in (1, 2, 7):
        assert np.allclose(lmscore.walk(b, machine, order, segment), whole)
    assert (machine.fail_to < np.arange(len(machine.fail_to)) + 1).all() and machine.fail_to[0] == 0
    assert (np.diff(machine.arc) > 0).all()


def test_rows_without_ids_and_repeats_are_spread(spark):
    rows = [(None, f"text {i}", "s", 1, 0, "c", 2) for i in range(400)] + [(7, f"other {i}", "s", 1, 0, "c", 2) for i in range(400)] + [(8, "same", "s", 1, 0, "c", 2)] * 400
    dealt = lmscore.in_blocks(frame(spark, rows).repartition(8), F.lit(False), 50)
    used = {r["doc_id"]: r["n"] for r in dealt.groupBy("doc_id").agg(F.count_distinct("block").alias("n")).collect()}
    assert used[None] > 40 and used[7] > 40 and used[8] > 1


def test_sample_is_bounded_by_rows(spark):
    rows = [(1, f"text {i}", "s", 1, 0, "c", 2) for i in range(500)] + [(i, f"t{i}", "s", 1, 0, "c", 2) for i in range(2, 60)]
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(1, 0, "x"), (None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    sample, totals = sampling.labelled_sample(frame(spark, rows), labels, "toxic", F.lit(True), per_class=20)
    got = sample.collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 40 and totals == [30, 30]


def test_models_and_scores_of_very_long_texts(spark):
    long = "word other third " * 120_000 + "\n" + "x" * 1_500_000
    rows = frame(spark, [(1, long, "s", 1, 0, "c", 2), (2, "word other", "s", 1, 0, "c", 2)])
    out = {r["doc_id"]: r for r in lmscore.language_model_scores(rows, F.lit(False)).collect()}
    assert out[1]["n_tokens"] == 360_002 and out[1]["score"] < out[2]["score"] < 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert len(toxicity.toxicity(rows, labels).collect()) == 2
    assert len(quality.quality(rows, labels.withColumnRenamed("toxic", "quality")).collect()) == 2
