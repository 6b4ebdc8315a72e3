"""Sharding, fill-in-middle and the Merkle manifest against plain Python, on odd rows and on none."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import infill, merkle, sharding
from tests.llm.test_texts import ODD

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, position long, path string, size string, shard_no int, n int, form string"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, g, len(t or ""), t, 1, "p", "s", 2, 3, "f") for i, s, g, t in rows], SCHEMA)


def odd_rows(seed=5, more=120):
    rng = random.Random(seed)
    rows = [(i, "s", rng.choice(["en", "de", None, "", "zz"]), t) for i, t in enumerate(ODD)]
    rows += [(None, None, None, None), (None, None, None, None), (3, "s", "en", "b\nc"), (3, "s", "en", "b\nc"), (5, "t", "de", "\n"), (6, "t", "de", "a <S> b\n")]
    rows += [(1000 + i, "u", rng.choice(["en", "en", "fr"]), "".join(rng.choice("ab \n") for _ in range(rng.randrange(60)))) for i in range(more)]
    return rows


# --- sharding


def least_capacity(sizes, shards):
    """By dynamic programming over all ways of cutting."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = [0] + [float("inf")] * len(sizes)
        for j in range(1, len(sizes) + 1):
            held = 0
            for i in range(j - 1, -1, -1):
                held += sizes[i]
                if held >= new[j]:
                    break
                new[j] = min(new[j], max(best[i], held))
        best = new
    return best[-1]


def check_plan(plan, atoms, shards):
    order = sorted(atoms)
    shard = {k: plan.own.index(k) if k in plan.own else len(plan.own) + sum(c <= k for c in plan.cuts) for k in order}
    held = [0] * shards
    for k, s in shard.items():
        held[s] += atoms[k]
    rest = [k for k in order if k not in plan.own]
    assert [shard[k] for k in rest] == sorted(shard[k] for k in rest)
    total, left = sum(atoms.values()), shards
    for k in sorted(atoms, key=lambda k: (-atoms[k], k)):
        if left == 1 or atoms[k] * left <= total:
            break
        assert plan.own[shards - left] == k
        total, left = total - atoms[k], left - 1
    assert left == shards - len(plan.own)
    assert max(held[len(plan.own) :], default=0) == (least_capacity([atoms[k] for k in rest], left) if rest else 0) == plan.capacity
    return held


@pytest.mark.parametrize("seed,n,shards,large", [(1, 150, 7, 0), (2, 150, 16, 2), (3, 5, 8, 0), (4, 400, 3, 1), (5, 60, 60, 0), (6, 300, 16, 0)])
def test_plan_has_the_least_capacity(spark, seed, n, shards, large):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(1.2) * 10) for _ in range(n)] + [100_000 * (i + 1) for i in range(large)]
    atoms = {hashlib.sha256(str(i).encode()).hexdigest(): s for i, s in enumerate(sizes)}
    plan = sharding.plan_shards(spark.createDataFrame(list(atoms.items()), "key string, size long"), shards)
    check_plan(plan, atoms, shards)


def test_atoms_whose_hashes_begin_alike(spark):
    """Cells are split as deep as it takes."""
    atoms = {"abc" * 20 + f"{i:04x}": 10 + i % 7 for i in range(90)} | {"0" * 60 + f"{i:04x}": 3 for i in range(40)}
    plan = sharding.plan_shards(spark.createDataFrame(list(atoms.items()), "key string, size long"), 9)
    held = check_plan(plan, atoms, 9)
    assert max(held) - min(held) <= 16


def test_assigned_shards(spark):
    rows = odd_rows() + [(5000 + i, "hot", "en", "the same text of many rows " * 3) for i in range(200)]
    got = sharding.assign_shards(frame(spark, rows), 6).collect()
    assert len(got) == len(rows)
    atoms, texts = {}, {}
    for _, _, _, t in rows:
        raw = (t or "").encode()
        key = hashlib.sha256(raw).hexdigest()
        atoms[key] = atoms.get(key, 0) + len(raw) + 1
        texts[key] = raw
    held = check_plan(sharding.plan_documents(frame(spark, rows), 6), atoms, 6)
    assert len({(r["key"], r["shard"]) for r in got}) == len(atoms)
    for s in range(6):
        own = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [(r["key"], -1 if r["doc_id"] is None else r["doc_id"]) for r in own] == sorted((r["key"], -1 if r["doc_id"] is None else r["doc_id"]) for r in own)
        assert sum(r["size"] for r in own) == held[s]
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len(texts[r["key"]]) + 1, zlib.crc32(texts[r["key"]]))


def test_sharding_of_nothing_and_of_one(spark):
    empty = frame(spark, [])
    assert sharding.assign_shards(empty, 4).collect() == []
    assert sharding.plan_documents(empty, 4).cuts == ()
    assert [tuple(r) for r in sharding.sharding_digest(frame(spark, [(None, None, None, None)]), 4).collect()] == [(None, 1, 0, "bytes", 0, 0, None)]
    with pytest.raises(ValueError):
        sharding.plan_documents(empty, 0)


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = frame(spark, rows)
    plan = sharding.plan_documents(docs, 5)
    sharding.write_shards(docs, str(tmp_path / "shards"), plan, tasks=7)
    back = spark.read.parquet(str(tmp_path / "shards"))
    want = sorted(map(str, docs.withColumn("shard", plan.shard(sharding.text_key(F.coalesce("text", F.lit(""))))).collect()))
    assert sorted(map(str, back.select(*docs.columns, "shard").collect())) == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "other"), plan)


# --- fill in the middle


def lines(text):
    return text.splitlines(keepends=True) if "\n" in text and not set("\x0b\x0c\r\x1c\x1d\x1e\x85  ") & set(text) else [x + "\n" for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]


def brute_infill(doc_id, text, seed=7, rate=100, spm=50):
    text, units = text or "", lines(text or "")
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (70, 100)])
def test_infill_equals_plain_python(spark, rate, spm):
    rows = odd_rows() + [(7000 + i, "s", "en", t) for i, t in enumerate(["\n" * 300_000, "a\r\nb c\n", "<" + "\nP>" * 50, "x" * 3_000_000, "é😀\n" * 1000, "<P", "P>\n<S\n"])]
    made = infill.fill_in_middle(frame(spark, rows), rate=rate, spm=spm)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str(r)
    want = [(i, *brute_infill(i, t, 7, rate, spm), t or "") for i, _, _, t in rows]
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in got)
    assert {r["form"] for r in got} >= {"plain", "spm" if spm else "psm"}


def test_infill_by_words_and_of_nothing(spark):
    assert infill.infill_digest(infill.fill_in_middle(frame(spark, []))).collect() == []
    rows = [(i, "s", "en", "some words  and more of them ") for i in range(30)]
    got = infill.fill_in_middle(frame(spark, rows), unit=r"\S+\s*").collect()
    assert {r["n"] for r in got} == {6}
    ends = {0, 5, 12, 16, 21, 24, 29}
    assert {r["prefix_chars"] for r in got} <= ends and {r["prefix_chars"] + r["middle_chars"] for r in got} <= ends
    with pytest.raises(ValueError):
        infill.fill_in_middle(frame(spark, []), marks=("<P>", "<P>", "<M>"))


# --- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha("".join(at[i : i + 2])) for i in range(0, len(at), 2)])
    return levels


def siblings(levels, i):
    out = []
    for at in levels[:-1]:
        out.append(("L" if i % 2 else "R") + at[i ^ 1] if i ^ 1 < len(at) else "")
        i >>= 1
    return out


def brute_manifest(rows):
    """A sorted list of (leaf, path, subroot, root)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = [(g, i, sha("".join(map(field, (i, s, g, len(t or ""), t))))) for i, s, g, t in rows]
    order = lambda v, low: (v is not None, v.encode() if isinstance(v, str) else v or low)
    groups = {g: sorted((x for x in leaves if x[0] == g), key=lambda x: (order(x[1], 0), x[2])) for g in sorted({x[0] for x in leaves}, key=lambda g: order(g, b""))}
    trees = {g: tree([x[2] for x in xs]) for g, xs in groups.items()}
    top = tree([t[-1][0] for t in trees.values()])
    out = []
    for k, (g, xs) in enumerate(groups.items()):
        out += [(x[2], siblings(trees[g], i) + siblings(top, k), trees[g][-1][0], top[-1][0]) for i, x in enumerate(xs)]
    return sorted(map(str, out))


@pytest.mark.parametrize("leaves,height,subtree", [(1, 4, 2), (2, 1, 1), (5, 3, 2), (16, 4, 3), (13, 5, 2), (200, 8, 2), (129, 8, 4), (100, 7, 9)])
def test_fractal_paths(leaves, height, subtree):
    digests = [sha(str(i)) for i in range(leaves)]
    levels = [digests]
    for _ in range(height):
        at = levels[-1]
        levels.append([sha("".join(at[i : i + 2])) for i in range(0, len(at), 2)])
    got = list(merkle.fractal_paths(digests.__getitem__, leaves, height, subtree))
    assert got == [siblings(levels, i) for i in range(leaves)]
    assert merkle.block_root(digests, height) == levels[-1][0]


def test_fractal_memory_is_bounded(monkeypatch):
    """Two subtrees and a stack for each layer at most, and the next subtree is ready when it is needed."""
    made, late = [], []
    start, finish = merkle.Desired.__init__, merkle.Desired.finish

    def begin(self, *a):
        start(self, *a)
        made.append(self)
        self.first = len(made) <= 5

    def end(self):
        late.append(not self.first and (self.next < self.end or len(self.stack) > 1))
        return finish(self)

    monkeypatch.setattr(merkle.Desired, "__init__", begin)
    monkeypatch.setattr(merkle.Desired, "finish", end)
    digests = [sha(str(i)) for i in range(1024)]
    for _ in merkle.fractal_paths(digests.__getitem__, 1024, 10, 2):
        assert all(len(t.stack) <= 11 and len(t.kept) <= 8 for t in made[-40:])
    assert not any(late)


@pytest.mark.parametrize("block_height,subtree", [(8, 2), (2, 1), (1, 1), (3, 2)])
def test_manifest_equals_plain_python(spark, block_height, subtree):
    rows = odd_rows(more=60)
    got = merkle.merkle_manifest(frame(spark, rows), block_height=block_height, subtree=subtree).collect()
    assert sorted(str((r["leaf"], r["path"], r["subroot"], r["root"])) for r in got) == brute_manifest(rows)


def test_small_manifests(spark):
    assert merkle.tampered_manifest(frame(spark, [])).collect() == []
    for rows in ([(4, "s", None, "text")], [(4, "s", "x", "text"), (5, None, "x", None)], [(4, "s", "b", "text"), (4, "s", "a", "text"), (4, "s", None, "text")]):
        got = merkle.merkle_manifest(frame(spark, rows)).collect()
        assert sorted(str((r["leaf"], r["path"], r["subroot"], r["root"])) for r in got) == brute_manifest(rows)


def test_tampering_shows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    got = merkle.tampered_manifest(docs).collect()
    hit = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0
    assert sum(hit(r["doc_id"]) for r in got) > 10
    assert all(r["verified"] == (not hit(r["doc_id"])) == (r["folded_root"] == r["root"]) for r in got)
    nothing = docs.withColumn("n_chars", F.lit(None).cast("long"))
    assert all(r["verified"] for r in merkle.tampered_manifest(nothing).collect())
    paths = {r["leaf"]: r["path"] for r in merkle.merkle_manifest(docs).collect()}
    for r in got:
        assert r["leaf"] in paths
    proofs = {sha("".join(s[1:] for s in p)) for p in paths.values()}
    assert {r["proof_sha256"] for r in got} <= proofs
