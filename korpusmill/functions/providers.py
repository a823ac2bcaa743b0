"""Models as columns: embedders and re-rankers that are set up once a worker and read batches of a given size.

A provider is any object with ``dims`` and ``embed(texts) -> array of shape (n, dims)``, or with ``score(queries, texts) -> array of
n``; it is made on the worker by a function without arguments, so weights are loaded where they are used.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from korpusmill.functions.batches import ship


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


#: Models of this worker process, by the key of the column that made them.
_made: dict[str, object] = {}


def _once(key: str, make: Callable):
    if key not in _made:
        _made[key] = make()
    return _made[key]


def embed_all(model: Embedder, texts: list[str], batch: int = 32) -> np.ndarray:
    """Vectors of all texts, ``batch`` of them at a time; no texts give an array of shape (0, dims)."""
    parts = [np.asarray(model.embed(texts[i : i + batch]), np.float64).reshape(-1, model.dims) for i in range(0, len(texts), batch)]
    return np.concatenate([np.zeros((0, model.dims)), *parts])


def embedder(spark: SparkSession, make: Callable[[], Embedder], batch: int = 32) -> Callable[[Column], Column]:
    """A function from a text column to an array of doubles. A null text has no vector; an empty one has what the model gives it."""
    ship(spark)
    key = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _once(key, make)
        for texts in batches:
            some = texts.notna().to_numpy()
            out = np.full(len(texts), None, object)
            for i, vector in zip(np.flatnonzero(some), embed_all(model, texts[some].tolist(), batch), strict=True):
                out[i] = vector
            yield pd.Series(out)

    return run


def reranker(spark: SparkSession, make: Callable[[], Reranker], batch: int = 32) -> Callable[[Column, Column], Column]:
    """A function from a query and a text column to a score, for :func:`korpusmill.operators.retrieval.rerank`. Nulls are empty texts."""
    ship(spark)
    key = uuid.uuid4().hex

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _once(key, make)
        for queries, texts in batches:
            q, t = queries.fillna("").tolist(), texts.fillna("").tolist()
            parts = [np.asarray(model.score(q[i : i + batch], t[i : i + batch]), np.float64) for i in range(0, len(q), batch)]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    return run


class HashEmbedder:
    """The offline stand-in of :func:`korpusmill.functions.vectors.hash_embedding` as a provider: counts of words in hashed dimensions, at unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in re.findall(r"[^\W_]+", text.lower()):
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class OverlapReranker:
    """Share of the query's distinct words that the text has, as :func:`korpusmill.operators.retrieval.overlap`."""

    def score(self, queries: list[str], texts: list[str]) -> np.ndarray:
        words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
        return np.array([round(len(words(q) & words(t)) / len(words(q)), 6) if words(q) else 0.0 for q, t in zip(queries, texts, strict=True)])
