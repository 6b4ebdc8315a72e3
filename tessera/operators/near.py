"""Exact nearest neighbours of all vectors, by lists around centroids that are compared only where they can matter.

Every vector is in the list of its nearest centroid, and a list knows how far its vectors lie
from the centroid. A vector's k best inside its own part of a list bound how far the k-th
neighbour can be; by the triangle inequality a list whose centroid is farther than that and its
radius holds none, so the vector never visits it. What is skipped depends on how the vectors
lie: vectors without clusters visit all lists, as an exact search then must.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Vectors in one part of a list, if it isn't given: the least, and numbers that the most may hold. Few large parts let each vector be
#: copied to few others; but up to SPREAD lists are made before parts grow, so that tasks have work.
PART_ROWS, PART_NUMBERS, SPREAD = 4096, 1 << 21, 8
#: Rows of a strip of products, and groups of columns of which the best is looked at first.
STRIP, GROUPS = 256, 256
#: Lists at most; centroids are sent to every task, 8 bytes a number.
MOST_LISTS = 8192


def units(values) -> np.ndarray:
    x = np.stack(values).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def with_direction(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as doubles; null ones and those without a finite length above zero are left out."""
    norm = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where((norm > 0) & (norm < float("inf")))


def centroids(rows: DataFrame, lists: int, rounds: int = 4) -> np.ndarray:
    """At most `lists` unit centroids of rows (id, v), by rounds of k-means whose sums are made in tasks and aggregated.

    They begin as the first vectors by a hash of their ids. The driver holds the centroids alone.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("id"), "id").limit(lists).toPandas()
    if not len(first):
        return np.zeros((0, 1))
    centres = units(first["v"])
    for _ in range(rounds if len(centres) > 1 else 0):
        shared = spark.sparkContext.broadcast(centres)

        def sums(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for f in frames:
                if len(f):
                    x = units(f["v"])
                    np.add.at(total, np.argmax(x @ shared.value.T, axis=1), x)
            hit = np.flatnonzero(np.abs(total).sum(axis=1))
            if len(hit):
                yield pd.DataFrame({"list": hit, "part": total[hit].tolist()})

        def added(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"list": f["list"].iloc[:1], "part": [np.sum(np.stack(f["part"].to_numpy()), axis=0).tolist()]})

        made = rows.mapInPandas(sums, "list bigint, part array<double>").groupBy("list").applyInPandas(added, "list bigint, part array<double>").toPandas()
        moved = centres.copy()
        at = np.stack(made["part"].to_numpy())
        size = np.linalg.norm(at, axis=1, keepdims=True)
        moved[made["list"]] = np.where(size > 0, at / np.where(size > 0, size, 1), moved[made["list"]])
        shared.unpersist()
        centres = moved
    return centres


def assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (id, v) with list, the nearest centroid's number, and far, the distance of the unit vector from it."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = units(f["v"])
                own = np.argmax(x @ shared.value.T, axis=1)
                yield f.assign(list=own, far=np.linalg.norm(x - shared.value[own], axis=1))

    return rows.mapInPandas(assign, "id bigint, v array<double>, list bigint, far double")


def _best(p: np.ndarray, q: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, id, score) of the k best of q for each row of p, equal scores by id; scores under floor - 1e-11 may be left out.

    Unit vectors in single precision choose the candidates: GROUPS maxima of columns bound the k-th best from below, and
    what is below that bound by more than both roundings can't be among the best. The candidates are scored in double precision.
    """
    by_id = np.argsort(ids, kind="stable")
    q, ids = q[by_id], ids[by_id]
    p_norm, q_norm = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1)
    slack = 4 * (p.shape[1] + 8) * 2.0**-24 + 1e-11
    wide = -(-len(q) // min(len(q), max(GROUPS, 4 * k)))
    columns = np.zeros((-(-len(q) // wide) * wide, q.shape[1]), dtype=np.float32)
    columns[: len(q)] = q / q_norm[:, None]
    columns[len(q) :] = columns[0]  # the last group is filled up; what it finds there isn't counted
    rows, others, scores = [], [], []
    for at in range(0, len(p), STRIP):
        x, x_norm = p[at : at + STRIP], p_norm[at : at + STRIP]
        near = (x / x_norm[:, None]).astype(np.float32) @ columns.T
        bound = floor[at : at + STRIP].copy()
        if len(q) >= k:
            tops = near[:, : len(q) // wide * wide].reshape(len(x), -1, wide).max(axis=2)
            if tops.shape[1] >= k:
                bound = np.maximum(bound, np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k])
        row, col = np.nonzero(near[:, : len(q)] >= (bound - slack).astype(np.float32)[:, None])
        many = np.bincount(row, minlength=len(x)) > 64 + 8 * k
        few = ~many[row]
        row, col = row[few], col[few]
        score = np.einsum("ij,ij->i", x[row], q[col]) / (x_norm[row] * q_norm[col])
        parts = [(row, col, np.round(score, 12))]
        for i in np.flatnonzero(many):  # very many equal or nearly equal ones
            all_ = np.round(q @ x[i] / (x_norm[i] * q_norm), 12)
            some = np.flatnonzero(all_ >= np.partition(all_, len(all_) - k)[len(all_) - k]) if len(all_) > k else np.arange(len(all_))
            some = some[np.argsort(-all_[some], kind="stable")[:k]]
            parts.append((np.full(len(some), i), some, all_[some]))
        row, col, score = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(at + row[first])
        others.append(ids[col[first]])
        scores.append(score[first])
    return np.concatenate(rows), np.concatenate(others), np.concatenate(scores)


def _block(k: int):
    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        """The k best of y for each row of x, equal scores by id; none that is worse than the k that the row has."""
        columns: dict = {"id": [], "other": [], "score": []}
        if len(x) and len(y):
            row, other, score = _best(np.stack(x["v"].to_numpy()), np.stack(y["w"].to_numpy()), y["other"].to_numpy(), k, x["worst"].to_numpy())
            kept = score >= x["worst"].to_numpy()[row]
            columns = {"id": x["id"].to_numpy()[row[kept]], "other": other[kept], "score": score[kept]}
        return pd.DataFrame(columns).astype({"id": "int64", "other": "int64", "score": "float64"})

    return run


def _visits(placed: DataFrame, found: DataFrame, centres: np.ndarray, k: int) -> DataFrame:
    """(id, v, worst, a, b): each vector beside every part of another list, or further part of its own, that may hold one of its k nearest."""
    spark = placed.sparkSession
    worst = found.groupBy("id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("worst"))
    radii = placed.groupBy("list").agg(F.max("far").alias("radius"), F.max("sub").alias("last")).toPandas().sort_values("list")
    numbers, radius, last = (radii[c].to_numpy() for c in ("list", "radius", "last"))
    shared = spark.sparkContext.broadcast((centres[numbers], numbers, radius, last))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, numbers, radius, last = shared.value
        for f in frames:
            for i in range(0, len(f), STRIP):
                g = f.iloc[i : i + STRIP]
                x = units(g["v"])
                far = np.sqrt(np.maximum(0, 2 - 2 * (x @ at.T)))
                reach = np.sqrt(np.maximum(0, 2 - 2 * g["worst"].to_numpy())) + 1e-6
                row, col = np.nonzero(far - radius[None, :] <= reach[:, None])
                times = last[col] + 1
                row, col = np.repeat(row, times), np.repeat(col, times)
                sub = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                other = ~((numbers[col] == g["list"].to_numpy()[row]) & (sub == g["sub"].to_numpy()[row]))
                row, col, sub = row[other], col[other], sub[other]
                out = g.iloc[row][["id", "v", "worst", "list", "sub"]].rename(columns={"list": "a_list", "sub": "a_sub"})
                yield out.assign(b_list=numbers[col], b_sub=sub)

    return placed.join(worst, "id").select("id", "v", "list", "sub", "worst").mapInPandas(choose, "id bigint, v array<double>, worst double, a_list bigint, a_sub bigint, b_list bigint, b_sub bigint")


def neighbours(vectors: DataFrame, key: str, vector: str, k: int, part_rows: int | None = None, parts: int | None = None, told: dict | None = None) -> DataFrame:
    """(id, other, score, rank): the exact k nearest of every vector by cosine, itself among them, ties by id.

    Lists are made for about part_rows vectors each, or by the size of vectors (or as many as given); a larger one has several parts. Ids should
    be unique. told: gets the numbers of blocks of two parts there are and of those compared.
    """
    rows = materialize(with_direction(vectors, key, vector))
    count, length = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    part_rows = part_rows or max(PART_ROWS, min(PART_NUMBERS // max(length, 1), -(-count // SPREAD)))
    lists = min(parts or max(1, -(-count // part_rows)), MOST_LISTS)
    centres = centroids(rows, lists)
    listed = assigned(rows, centres) if len(centres) else rows.select("*", F.lit(0).cast("long").alias("list"), F.lit(0.0).alias("far"))
    listed = materialize(listed)
    subs = listed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).alias("subs"))
    placed = materialize(listed.join(F.broadcast(subs), "list").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("long")).drop("subs"))
    schema, block = "id bigint, other bigint, score double", _block(k)

    def right(df: DataFrame, *keys) -> DataFrame:
        return df.select(F.col("id").alias("other"), F.col("v").alias("w"), *keys)

    part = (F.col("list").alias("b_list"), F.col("sub").alias("b_sub"))
    at_home = placed.select("id", "v", F.lit(-2.0).alias("worst"), *part).groupBy("b_list", "b_sub").cogroup(right(placed, *part).groupBy("b_list", "b_sub")).applyInPandas(block, schema)
    found = at_home
    if lists > 1 or placed.where("sub > 0").limit(1).count():
        at_home = materialize(at_home)
        visits = materialize(_visits(placed, at_home, centres, k))
        pair = ["a_list", "a_sub", "b_list", "b_sub"]
        blocks = visits.select(*[F.col(c).alias(c) for c in pair]).distinct()
        if told is not None:
            all_parts = placed.select("list", "sub").distinct().count()
            told |= {"blocks": all_parts * all_parts, "compared": blocks.count() + all_parts}
        targets = right(placed, *part).join(blocks, ["b_list", "b_sub"])
        found = at_home.unionAll(visits.groupBy(*pair).cogroup(targets.groupBy(*pair)).applyInPandas(block, schema))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
