"""Bounded labelled samples for the classifiers, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import stored


def fold(modulus: int, column: str = "doc_id") -> F.Column:
    """``crc32(doc_id as text) mod modulus``, the fold of a document (null doc_id: null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                    positives: int, negatives: int, max_chars: int) -> DataFrame:
    """``doc_id, y, weight, text`` of at most ``positives`` and ``negatives`` labelled documents outside the held-out fold.

    The documents with the smallest fingerprint of their id are taken, so the sample depends on nothing else; longer texts than
    ``max_chars`` and null texts are passed over.  A document with several labels counts as positive if one of them is.
    ``weight`` is the number of labels of the class for each one taken (1 unless its bound binds), so that weighted rows keep the
    ratio of the classes at every size.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(modulus) != held_out))
             .groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("doc_id")))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y, n in ((1, positives), (0, negatives)):
        part = known.where(F.col("y") == y).orderBy("o", "doc_id").limit(n).select(
            "doc_id", "y", F.lit(max(1.0, counts.get(y, 0) / n)).alias("weight"))
        picked = part if picked is None else picked.unionByName(part)
    picked = stored(picked, "picked")  # at most positives + negatives rows of 20 bytes: small enough to broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "weight").agg(F.min("text").alias("text"))
    return stored(found, "sample")


def unit_mean(weights: np.ndarray) -> np.ndarray:
    """Weights of mean 1, against which a penalty means the same whatever the rates of the sample."""
    return weights / weights.mean()


class Logistic:
    """Ridge logistic regression of weighted rows on standardised features by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1.0, steps: int = 50):
        k = unit_mean(weights)
        self.mean = np.average(x, axis=0, weights=k)
        self.scale = np.average((x - self.mean) ** 2, axis=0, weights=k) ** 0.5 + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        penalty = np.diag(np.r_[1e-6, np.full(x.shape[1], ridge)])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (k * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (k * (p - y)) + penalty @ w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
