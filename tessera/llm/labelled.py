"""Bounded, deterministic samples of labelled documents, and training on them in one task of an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import doc_bucket

#: Bounds of a sample: text of one class in all, and of one document (longer ones are not learnt from, but are scored).
CLASS_BYTES, DOCUMENT_BYTES = 12 << 20, 1 << 17


def sample(documents: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], folds: int = 3, held_out: int = 1) -> tuple[DataFrame, dict[int, int]]:
    """(text, y, h, doc_id) of at most per_class[y] documents of each label y outside the held-out fold, with at most
    CLASS_BYTES of text, and how many labelled ones there are in all.

    Those with the smallest hashes of their ids are taken, found without their texts; whole texts are then read.  Null
    labels, ids and texts are passed over; of several texts under one id the one with the smallest hash is taken, and of
    several labels the larger."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").where(doc_bucket(F.col("doc_id"), folds) != held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(5)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where(F.col("y").isin(0, 1)).collect()}
    chosen = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(n) for y, n in per_class.items()]
    ids = chosen[0]
    for other in chosen[1:]:
        ids = ids.unionByName(other)
    docs = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= DOCUMENT_BYTES))
    # ids has sum(per_class) rows at most, so it may be broadcast, and a class of them ranked in one task.
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "h").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).where(F.col("upto") <= CLASS_BYTES).select("text", "y", "h", "doc_id"), counts


def trained(rows: DataFrame, fit: Callable[[list[str], np.ndarray], object]):
    """What fit makes of a sample's texts and labels, in the order of their hashes: a small object, made in one task, so
    that neither the driver nor its memory takes part in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("h", "ascending"), ("doc_id", "ascending")])
            made = fit(table["text"].to_pylist(), table["y"].to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit([], np.zeros(0, np.int64))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features: (mean, scale, coefficients with the intercept last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    keep = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def chance(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, beta = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ beta[:-1] + beta[-1], -30, 30)))
