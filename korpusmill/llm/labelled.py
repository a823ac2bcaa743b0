"""Labelled rows for fitting, and the small numeric helpers of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; rows at 0 are held out of fitting."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of their id.

    Rows with a null label go; of several labels of one document the smallest counts. The chosen labels are bounded by
    ``most``, so they are broadcast. A document whose id is repeated gives one row, of the text with the smallest hash.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("of"), F.col(label).cast("int").alias("label")).filter("of is not null and label is not null")
        .filter(fold(F.col("of")) != 0).groupBy("of").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("of"), "of").limit(most)
    )
    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("of"))
    one = found.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("row"))
    return one.select("id", "row.text", "row.label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def split(n: int, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below n for fitting and for calibration."""
    order = np.random.default_rng(seed).permutation(n)
    k = int(n * share)
    return order[k:], order[:k]


class Adam:
    """The update rule, over a list of arrays changed in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m, self.v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for w, g, m, v in zip(self.weights, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
