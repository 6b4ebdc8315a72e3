"""A vector index by lists around centroids, and exact nearest neighbours from few of its lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near

def write_vector_index(vectors: DataFrame, key: str, vector: str, path: str, lists: int | None = None) -> None:
    """Lists (id, v) in folders by list, and one row for each list: its centroid, radius and size.

    Every vector that has a direction is in a list. Null and zero vectors are left out, as they have no neighbours.
    lists: the root of the vectors' number if not given, and no more than near.MOST_LISTS.
    """
    spark = vectors.sparkSession
    rows = near.with_direction(vectors, key, vector)
    centres = near.centroids(rows, min(lists or max(1, math.isqrt(rows.count())), near.MOST_LISTS))
    assigned = near.assigned(rows, centres) if len(centres) else rows.selectExpr("id", "v", "0L as list", "0d as far")
    assigned.repartition("list", F.pmod(F.xxhash64("id"), F.lit(4))).write.partitionBy("list").parquet(f"{path}/lists")
    stored = spark.read.parquet(f"{path}/lists")
    radii = {r["list"]: (r["radius"], r["size"]) for r in stored.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("size")).collect()}
    table = pd.DataFrame([(i, c.tolist(), *radii[i]) for i, c in enumerate(centres) if i in radii], columns=["list", "centre", "radius", "size"])
    spark.createDataFrame(table, "list bigint, centre array<double>, radius double, size bigint").coalesce(1).write.parquet(f"{path}/centres")


def nearest(spark, path: str, query: Sequence[float], k: int, probes: int = 4) -> DataFrame:
    """(id, score): the k nearest by cosine, exactly, ties by id.

    The nearest `probes` lists (or as many as hold k rows) give a bound; of the others only those that their
    radius allows to hold anything as near are read.
    """
    from .search import cosine

    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)
    table = spark.read.parquet(f"{path}/centres").toPandas().sort_values("list")
    distance = np.linalg.norm(np.stack(table["centre"].to_numpy()) - q, axis=1)
    order = np.argsort(distance, kind="stable")
    enough = int(np.searchsorted(np.cumsum(table["size"].to_numpy()[order]), k)) + 1
    listed = F.array(*[F.lit(float(x)) for x in query])
    rows = spark.read.parquet(f"{path}/lists")

    def best(lists) -> DataFrame:
        some = rows.where(F.col("list").isin(*[int(x) for x in lists]))
        return some.select("id", F.round(cosine(F.col("v"), listed), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    first = table["list"].to_numpy()[order[: max(probes, enough)]]
    found = best(first).collect()
    worst = min((r["score"] for r in found), default=-1.0) if len(found) == k else -1.0
    reach = math.sqrt(max(0.0, 2 - 2 * worst)) + 1e-6
    return best(table["list"].to_numpy()[(distance - table["radius"].to_numpy()) <= reach])
