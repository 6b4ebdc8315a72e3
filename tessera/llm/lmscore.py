"""Language-model scores by a weighted backoff automaton over all training texts.

States are the contexts seen in training, the root the empty one. An arc leads from a context
by a word that followed it to the longest state that ends the two, with the word's smoothed
probability; a failure arc leads from a context to the next shorter one with the weight of what
the arcs leave:

    p(w | context) = (count(context w) + k p(w | shorter)) / (count(context) + k)
    failure weight = k / (count(context) + k)

Texts are walked from left to right: each step takes the state's arc for the word, or failure
arcs until there is one, adds the logarithms and carries the state on. All texts of a block step
together. Long texts are walked in segments that begin order - 1 tokens early, because those
tokens alone settle the state.

The automaton of the corpus never exists in one place. Texts are dealt into blocks of bounded
size; each block asks for the n-grams that occur in it, sorted by hash, with its own counts.
Hash ranges add up all blocks' counts and answer in the order of the question, so answers are
counts alone. A block then builds just the part of the automaton that its texts walk through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import text_or_empty
from .textscan import SPACES, mix, scan

#: Hashes of the end token and of the beginning of a text, which is a context but no token.
END, BEGIN = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Low bits that n-grams of two and more tokens drop from their hashes.
_DROP = np.uint64(12)
_LOG = math.log(10.0)
#: Tokens of a text that are walked in one go.
SEGMENT = 256
#: Bytes of text in a block at least, and of text for each row of counts: blocks grow with the root of the corpus, so rows grow in proportion to it.
BLOCK_BYTES, ROW_BYTES = 8 << 20, 1000


@dataclass
class Block:
    """All tokens of a block: text, place in it (BEGIN is 0), training or not, and for each order the n-gram ending there.

    An n-gram that would reach before its text's BEGIN is the shorter one that begins there.
    """

    doc: np.ndarray
    place: np.ndarray
    train: np.ndarray
    keys: list[np.ndarray]
    index: list[np.ndarray]
    begin: int


def block_ngrams(texts, held_out: np.ndarray, order: int) -> Block:
    """n-grams of every order; shorter ones at a text's start begin with its BEGIN."""
    words, docs = [], []
    for s in scan(texts, SPACES):
        count = s.counts()
        at = s.first[:-1] + np.arange(s.n) * 2  # a place for BEGIN before each text and for END behind it
        out = np.empty(len(s.start) + 2 * s.n, dtype=np.uint64)
        out[at] = BEGIN
        out[at + count + 1] = END
        out[np.arange(len(s.start)) + 2 * s.doc + 1] = s.hashes()
        words.append(out)
        docs.append(np.repeat(np.arange(s.lo, s.lo + s.n), count + 2))
    word = np.concatenate(words) if words else np.zeros(0, np.uint64)
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    token = word != BEGIN
    keys, index = [], []
    code = word
    for k in range(order):
        if k:
            longer = mix(np.concatenate([[BEGIN], code[:-1]])[: len(word)] * _STEP + word)
            longer = longer >> _DROP << _DROP
            # an n-gram that would reach before its text's beginning is the shorter one that starts there
            inside = np.zeros(len(word), dtype=bool)
            inside[k:] = doc[k:] == doc[:-k] if k < len(word) else False
            code = np.where(inside, longer, code if k > 1 else word)
        unique, inverse = np.unique(code, return_inverse=True)
        keys.append(unique)
        index.append(inverse)
    begin = int(np.searchsorted(keys[0], BEGIN)) if len(word) else 0
    starts = np.flatnonzero(~token)
    place = np.arange(len(word)) - np.repeat(starts, np.diff(np.append(starts, len(word))))
    return Block(doc, place, token & ~held_out[doc] if len(doc) else token, keys, index, begin)


def _pack(values: np.ndarray) -> bytes:
    """Bytes of equal significance side by side, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _ranges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2**bits hash ranges in sorted keys."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    return np.append(np.searchsorted(keys, starts), len(keys))


def _questions(order: int, bits: int):
    """From a block's texts: for each hash range a row with every order's keys and the block's training counts."""

    def run(table: pa.Table) -> pa.Table:
        held = table["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        b = block_ngrams(table["text"], held, order)
        # BEGIN is counted as a context, once for each training text
        counts = []
        for k in range(order):
            use = b.train | ((k == 0) & (b.index[0] == b.begin) & ~held[b.doc]) if len(b.doc) else b.train
            counts.append(np.bincount(b.index[k][use], minlength=len(b.keys[k])))
        bounds = [_ranges(k, bits) for k in b.keys]
        block = table["block"][0].as_py()
        rows = {"part": [], "block": [], "payload": []}
        for part in range(1 << bits):
            spans = [(x[part], x[part + 1]) for x in bounds]
            if all(i == j for i, j in spans):
                continue
            pieces = []
            for (i, j), key, count in zip(spans, b.keys, counts):
                pieces += [_pack(np.diff(key[i:j], prepend=np.uint64(0))), _pack(count[i:j])]
            rows["part"].append(part)
            rows["block"].append(block)
            rows["payload"].append(_join(pieces))
        return pa.table(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())]))

    return run


def _join(pieces: list[bytes]) -> bytes:
    return np.array([len(pieces), *map(len, pieces)], dtype="<i8").tobytes() + b"".join(pieces)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, dtype="<i8", count=1)[0])
    ends = np.cumsum(np.frombuffer(data, dtype="<i8", count=n, offset=8)) + 8 * (n + 1)
    return [data[j - k : j] for j, k in zip(ends, np.diff(ends, prepend=8 * (n + 1)))]


def _answers(order: int):
    """From all questions of a hash range: each block's counts over all blocks, and the range's share of the totals."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_split(x) for x in table["payload"].to_pylist()]
        answers = [[] for _ in asked]
        totals = np.zeros(4, dtype=np.int64)
        for k in range(order):
            keys = [np.cumsum(_unpack(a[2 * k]), dtype=np.uint64) for a in asked]
            unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([_unpack(a[2 * k + 1]) for a in asked]), minlength=len(unique))
            count = count.astype(np.int64)
            if k == 0:
                own = count[unique != BEGIN]
                totals[:] = own.sum(), (own > 0).sum(), (own == 1).sum(), (own == 2).sum()
            at = 0
            for answer, key in zip(answers, keys):
                answer.append(_pack(count[inverse[at : at + len(key)]]))
                at += len(key)
        zero = np.zeros(4, dtype="<i8").tobytes()
        payload = [_join([totals.astype("<i8").tobytes() if i == 0 else zero, *a]) for i, a in enumerate(answers)]
        return pa.table({"block": table["block"], "part": table["part"], "payload": pa.array(payload, pa.binary())})

    return run


def _sum_totals(batches):
    out = np.zeros(4, dtype=np.int64)
    for b in batches:
        for payload in b.column("payload"):
            out += np.frombuffer(_split(payload.as_py())[0], dtype="<i8")
    yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in out], names=["tokens", "types", "ones", "twos"])


@dataclass
class Automaton:
    """Arcs sorted by state and word, those of the root (state 0) by word, and each state's failure arc; weights are natural logarithms."""

    words: int
    arc: np.ndarray
    arc_to: np.ndarray
    arc_weight: np.ndarray
    root_to: np.ndarray
    root_weight: np.ndarray
    fail_to: np.ndarray
    fail_weight: np.ndarray

    @staticmethod
    def build(b: Block, counts: list[np.ndarray], totals: tuple[int, int, int, int], concentration: float) -> Automaton:
        """Of the n-grams of a block, with the corpus's counts of each."""
        tokens, types, ones, twos = (float(x) for x in totals)
        order, v = len(counts), len(counts[0])
        c = counts[0].astype(np.float64)
        discount = np.clip(ones / (ones + 2 * twos), 0.1, 0.95) if ones else 0.5
        p = (np.maximum(c - discount, 0) + discount * types / (types + 1)) / tokens if tokens else np.ones(v)
        # states: the root, then the contexts of one token, of two, ...
        base = np.concatenate([[1], 1 + np.cumsum([len(x) for x in counts[: order - 1]])]).astype(np.int64)
        fail_to, fail_weight = np.zeros(base[-1], dtype=np.int64), np.zeros(base[-1])
        root_weight = np.log(p)
        root_to = np.where(counts[0] > 0, base[0] + np.arange(v), 0) if order > 1 else np.zeros(v, dtype=np.int64)
        arcs = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k in range(1, order):
            at = np.zeros(len(counts[k]), dtype=np.int64)
            at[b.index[k][::-1]] = np.arange(len(b.doc) - 1, -1, -1)  # where each n-gram ends first
            whole = (b.place[at] >= k) & (counts[k] > 0)
            shorter, context, word = b.index[k - 1][at], b.index[k - 1][at - 1], b.index[0][at]
            own, seen = counts[k].astype(np.float64), counts[k - 1][context].astype(np.float64)
            p = np.where(whole, (own + concentration * p[shorter]) / (seen + concentration), p[shorter])
            state = base[k - 1] + np.arange(len(counts[k - 1]))
            fail_weight[state] = np.log(concentration) - np.log(counts[k - 1] + concentration)
            to = base[k] + np.arange(len(counts[k])) if k + 1 < order else base[k - 1] + shorter
            if k + 1 < order:
                fail_to[to] = base[k - 1] + shorter
            arcs.append(((base[k - 1] + context[whole]) * v + word[whole], to[whole], np.log(p[whole])))
        arc, arc_to, arc_weight = (np.concatenate(x) for x in zip(*arcs))
        by = np.argsort(arc, kind="stable")
        return Automaton(v, arc[by], arc_to[by], arc_weight[by], root_to, root_weight, fail_to, fail_weight)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word each, and the logarithms of its probabilities."""
        to, weight = np.empty_like(state), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            at_root = state == 0
            done = left[at_root]
            to[done] = self.root_to[word[at_root]]
            weight[done] += self.root_weight[word[at_root]]
            left, state, word = left[~at_root], state[~at_root], word[~at_root]
            if not len(left):
                break
            wanted = state * self.words + word
            at = np.minimum(np.searchsorted(self.arc, wanted), max(len(self.arc) - 1, 0))
            found = self.arc[at] == wanted if len(self.arc) else np.zeros(len(left), dtype=bool)
            to[left[found]] = self.arc_to[at[found]]
            weight[left[found]] += self.arc_weight[at[found]]
            left, state, word = left[~found], state[~found], word[~found]
            weight[left] += self.fail_weight[state]
            state = self.fail_to[state]
        return to, weight


def walk(b: Block, automaton: Automaton, order: int, segment: int = SEGMENT) -> np.ndarray:
    """The logarithm of each token's probability (0 for BEGIN), by walks from left to right."""
    out = np.zeros(len(b.doc))
    if not len(b.doc):
        return out
    size = np.diff(np.append(np.flatnonzero(b.place == 0), len(b.doc)))
    first = np.flatnonzero(b.place == 0)
    pieces = -(-size // segment)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + piece * segment
    end = np.minimum(begin + segment, np.repeat(first + size, pieces))
    early = np.maximum(begin - (order - 1), np.repeat(first, pieces))
    by = np.argsort(early - end, kind="stable")  # the longest first, so that those still walking come first
    begin, end, early = begin[by], end[by], early[by]
    state = np.zeros(len(early), dtype=np.int64)
    length = end - early
    for t in range(int(length[0])):
        n = int(np.searchsorted(-length, -t, side="left"))
        at = early[:n] + t
        state[:n], weight = automaton.step(state[:n], b.index[0][at])
        scored = (at >= begin[:n]) & (b.place[at] > 0)
        out[at[scored]] = weight[scored]
    return out


def _scores(order: int, bits: int, concentration: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _RESULT})
        held = left["held_out"].to_numpy(zero_copy_only=False).astype(bool)
        b = block_ngrams(left["text"], held, order)
        parts = right["part"].to_numpy()
        place = np.argsort(parts)
        answers = [_split(right["payload"][int(i)].as_py()) for i in place]
        counts = [np.concatenate([_unpack(a[k + 1]) for a in answers]).astype(np.int64) for k in range(order)]
        if [len(x) for x in counts] != [len(x) for x in b.keys]:
            raise RuntimeError("a block's texts are not those that its questions came from")
        totals = tuple(right[n][0].as_py() for n in ("tokens", "types", "ones", "twos"))
        model = walk(b, Automaton.build(b, counts, totals, concentration), order) / _LOG
        token, n = b.place > 0, left.num_rows
        doc, own = b.doc[token], counts[0][b.index[0][token]]
        base = np.log((own + 1) / float(totals[0] + totals[1] + 1)) / _LOG
        out = [
            left["doc_id"], left["held_out"], np.bincount(doc, minlength=n),
            np.bincount(doc, weights=own > 0, minlength=n).astype(np.int64), np.full(n, totals[0]),
            np.bincount(doc, weights=base, minlength=n), np.bincount(doc, weights=model[token], minlength=n),
        ]
        return pa.table([pa.chunked_array([pa.array(x, t)]) if isinstance(x, np.ndarray) else x for x, (_, t) in zip(out, _RESULT)], names=[k for k, _ in _RESULT])

    return run


_RESULT = [
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
]


def in_blocks(docs: DataFrame, held_out: Column, blocks: int) -> DataFrame:
    """(block, doc_id, held_out, text) of every row."""
    key = F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), text_or_empty(docs), F.spark_partition_id())
    return docs.select(
        F.pmod(key, F.lit(blocks)).cast("int").alias("block"), docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), text_or_empty(docs).alias("text"),
    )


def language_model_scores(
    docs: DataFrame, held_out: Column, order: int = 2, concentration: float = 100.0, block_bytes: int | None = None
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from the rows where `held_out` isn't true. Tokens: runs without white space, ASCII
    letters lower-cased, then an end. score: the model's log10 probability of all of them;
    base_score: that of add-one unigrams. A null text counts as empty: its only token is
    the end. Repeated rows are texts of their own; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows. Without a training text every score is 0.

    Blocks hold about block_bytes of text, or one longer text; by default they grow with the
    square root of the corpus, so that the rows that blocks exchange grow in proportion to it and
    not with its square (8 MB up to 64 GB of text, 32 MB for 1 TB). Shuffled are the texts, once, and
    about five bytes for each different n-gram of a block. Which block a row is in follows from its
    id, its text and its partition, so rows of one id, or of none, and repeated rows are spread.
    """
    size = docs.agg(F.sum(F.octet_length(text_or_empty(docs))).alias("n")).first()["n"] or 0
    block_bytes = block_bytes or max(BLOCK_BYTES, math.isqrt(ROW_BYTES * size))
    blocks = max(1, math.ceil(size / block_bytes))
    bits = max(2, math.ceil(math.log2(blocks)))
    dealt = in_blocks(docs, held_out, blocks)
    questions = dealt.groupBy("block").applyInArrow(_questions(order, bits), "part int, block int, payload binary")
    answers = questions.groupBy("part").applyInArrow(_answers(order), "block int, part int, payload binary").repartition("block")
    totals = answers.mapInArrow(_sum_totals, "tokens bigint, types bigint, ones bigint, twos bigint").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "ones", "twos")]
    )
    told = answers.crossJoin(F.broadcast(totals))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(order, bits, concentration), schema)
