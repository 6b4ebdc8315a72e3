"""A bounded sample of labelled rows, and models fitted to it in one task of the cluster."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import text_or_empty


@dataclass
class Sample:
    """texts and 0/1 labels of the sampled rows; weights undo the equal sampling of the classes."""

    texts: object
    label: np.ndarray
    weight: np.ndarray

    @property
    def usable(self) -> bool:
        return len(self.label) > 0 and 0 < int(self.label.sum()) < len(self.label)


@dataclass
class Fitted:
    """A pickled model, or none where a class had no example, and the share of label 1 among all labelled rows."""

    model: bytes | None
    share: float

    def load(self):
        return None if self.model is None else pickle.loads(self.model)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_class: int = 4000, max_chars: int = 20_000
) -> tuple[DataFrame, list[int]]:
    """(doc_id, label, text) of at most per_class labelled ids of each class, and how many ids of each class there are.

    The ids are the first by a hash; texts have at most max_chars characters. allowed: a
    condition on doc_id; rows where it isn't true are not learned from. Rows with a null id or
    label are no examples; of several labels of one id the largest counts, of several texts the
    least. The ids are chosen on the small labels table, so the broadcast holds 2 * per_class rows at most.
    """
    wanted = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & allowed)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    totals = {r["label"]: r["n"] for r in wanted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"))
    picks = [wanted.where(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs).alias("text")).where(
        F.length("text") <= max_chars
    )
    rows = texts.join(F.broadcast(picks[0].unionAll(picks[1])), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))
    return rows, [totals.get(0, 0), totals.get(1, 0)]


def fit_sample(rows: DataFrame, totals: list[int], fit: Callable[[Sample], object | None]) -> Fitted:
    """A model of the sample, fitted in one task: the driver sees the pickled model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("doc_id")
        y = np.asarray(table["label"].to_numpy(), dtype=np.int64)
        weight = (np.array(totals, dtype=float) / np.maximum(np.bincount(y, minlength=2), 1))[y]
        sample = Sample(table["text"], y, weight / weight.mean() if len(y) else weight)
        model = fit(sample) if sample.usable else None
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    every = sum(totals)
    return Fitted(bytes(found["model"]) if found else None, totals[1] / every if every else 0.5)
