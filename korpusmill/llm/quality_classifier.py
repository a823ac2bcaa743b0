"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import SPACE, SpanHash, fresh, runs, slices, utf8
from korpusmill.llm.labelled import Adam, labelled_sample, log_loss, sigmoid, split

#: Words share rows of the vector table by their hash, so its size does not depend on the corpus.
BUCKETS, DIMENSIONS, NONZERO, REACH = 8192, 32, 4, 2
BLOCK = 128

#: 0 white space, 1 letters, digits and all beyond ASCII, 2 ASCII symbols: a word is a run of one kind.
KIND = np.ones(256, np.uint8)
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = 2
KIND[SPACE] = 0

_rng = np.random.default_rng(20)
_POS = np.argsort(_rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word."""
    start, end, row = runs(KIND[data], offsets)
    if not len(start):
        return np.zeros(0, np.int64), row
    return (SpanHash(data)(start, end) & np.uint64(BUCKETS - 1)).astype(np.int64), row


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the index vectors of the neighbours of each bucket's words, and the words' count."""
    sums, count = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
    for b in slices(batches):
        word, row = tokens(*utf8(b.column(0)))
        count += np.bincount(word, minlength=BUCKETS)
        for d in range(1, REACH + 1):
            same = row[d:] == row[:-d]
            left, right = word[:-d][same], word[d:][same]
            for a, c in ((left, right), (right, left)):
                for j in range(NONZERO):
                    sums += np.bincount(a * DIMENSIONS + _POS[c, j], _SIGN[c, j], BUCKETS * DIMENSIONS)
    yield from _blocks(sums, count)


def _blocks(sums: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not count.any():
        return
    both = np.column_stack([sums.reshape(BUCKETS, DIMENSIONS), count]).astype(np.float32).reshape(BUCKETS // BLOCK, -1)
    yield pa.record_batch([pa.array(range(len(both)), pa.int32()), pa.array([x.tobytes() for x in both], pa.binary())], ["block", "data"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one partition; holds one table whatever the number of rows."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float32)
            total[k] = total[k] + x if k in total else x.astype(np.float64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["block", "data"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors of all buckets, from every word of every text; the table is of fixed size (1 MB)."""
    schema = "block int, data binary"
    part = map_batches(docs.select(F.col(text).alias("text")), _contexts, schema)
    rows = map_batches(part.repartition(BUCKETS // BLOCK, "block"), _add, schema).collect()
    both = np.zeros((BUCKETS // BLOCK, BLOCK * (DIMENSIONS + 1)))
    for r in rows:
        both[r.block] += np.frombuffer(r.data, np.float32)
    both = both.reshape(BUCKETS, DIMENSIONS + 1)
    sums, count = both[:, :-1], both[:, -1:]
    mean = sums.sum(axis=0) / max(count.sum(), 1)
    v = sums / np.maximum(count, 1) - mean  # what a word's contexts have beyond all words'
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, mean likeness of neighbours, and the log of the number of words."""
    n = len(offsets) - 1
    word, row = tokens(data, offsets)
    first, second, near = np.zeros((n, DIMENSIONS)), np.zeros((n, DIMENSIONS)), np.zeros(n)
    for i in range(0, len(word), step):  # bounded memory for texts of any length
        w, r = word[i : i + step + 1], row[i : i + step + 1]
        v = vectors[w]
        m = min(step, len(w))
        at = np.flatnonzero(np.append(True, r[1:m] != r[: m - 1]))
        first[r[at]] += np.add.reduceat(v[:m], at, axis=0)
        second[r[at]] += np.add.reduceat(v[:m] ** 2, at, axis=0)
        pair = np.einsum("ij,ij->i", v[:-1], v[1:]) * (r[:-1] == r[1:])
        near += np.bincount(r[:-1], pair, n)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)[:, None]
    mean = first / some
    spread = np.sqrt(np.maximum(second / some - mean**2, 0))
    return np.column_stack([mean, spread, near / np.maximum(count - 1, 1), np.log1p(count)]).astype(np.float32)


@dataclass
class QualityModel:
    """Vectors, standardisation, two layers and a temperature; ``score`` is the probability of label 1."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.maximum(((x - self.centre) / self.scale) @ a + b, 0) @ c + d

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x)[:, 0] / self.temperature)

    def score(self, docs: DataFrame, name: str = "score", text: str = "text") -> DataFrame:
        """``docs`` with the score of each whole text in column ``name``; null texts score as empty ones, rows that repeat alike; an empty table gives an empty result. A column of that name is replaced."""
        model = docs.sparkSession.sparkContext.broadcast(self)  # of fixed size
        at = docs.drop(name)
        place = at.columns.index(text)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = model.value
            for b in slices(batches, text):
                p = m.probabilities(pool(m.vectors, *utf8(b.column(place))))
                yield pa.record_batch([*b.columns, pa.array(p.astype(np.float64))], [*b.schema.names, name])

        from pyspark.sql.types import DoubleType, StructField, StructType

        return map_batches(at, run, StructType([*at.schema.fields, StructField(name, DoubleType())]))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 256, seed: int = 4) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float]:
    """Standardisation, weights and the temperature that suits a fifth of the rows, kept from the fit."""
    fit, held = split(len(y), 0.2, seed)
    centre, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    z, t = (x - centre) / scale, y.astype(np.float32)
    rng = np.random.default_rng(seed)
    a = (rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1])).astype(np.float32)
    layers = [a, np.zeros(hidden, np.float32), (rng.standard_normal((hidden, 1)) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)]
    adam = Adam(layers, 3e-3)
    for _ in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), batch):
            k = order[i : i + batch]
            h = np.maximum(z[k] @ layers[0] + layers[1], 0)
            g = (sigmoid(h @ layers[2] + layers[3]) - t[k, None]) / len(k)
            back = (g @ layers[2].T) * (h > 0)
            adam.step([z[k].T @ back + 1e-4 * layers[0], back.sum(axis=0), h.T @ g + 1e-4 * layers[2], g.sum(axis=0)])
    logit = (np.maximum(z[held] @ layers[0] + layers[1], 0) @ layers[2] + layers[3])[:, 0]
    temperature = min(np.exp(np.linspace(-1.5, 2.5, 81)), key=lambda s: log_loss(sigmoid(logit / s), t[held])) if len(held) else 1.0
    return centre, scale, layers, float(temperature)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Word vectors from all of ``docs``; the network from at most ``most`` labelled rows outside the held-out fold.

    Without labelled rows of both kinds, every text scores the smoothed share of label 1 (0.5 without labels); so it does for
    an empty table. Rows that repeat count each time for the vectors and once an id for the network; null texts are empty
    ones; very long texts are read whole, a piece at a time.
    """
    vectors = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = pool(shared.value, *utf8(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), b.column(2)], ["id", "x", "label"])

    sample = labelled_sample(docs, labels, most, doc_id=doc_id, text=text)
    rows = sorted(((r.id, bytes(r.x), r.label) for r in map_batches(sample, run, f"id {sample.schema['id'].dataType.simpleString()}, x binary, label int").collect()), key=lambda r: (r[0], r[1]))
    width = 2 * DIMENSIONS + 2
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, width).copy()
    y = np.array([r[2] for r in rows])
    if len(set(y.tolist())) < 2 or len(y) < 10:
        p = (y.sum() + 1) / (len(y) + 2)
        flat = [np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.full(1, np.log(p / (1 - p)), np.float32)]
        return QualityModel(vectors, np.zeros(width), np.ones(width), flat, 1.0)
    return QualityModel(vectors, *fit_network(x, y))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the same columns; rows that repeat stay or go together, and null, empty and very long texts by their score; an empty table stays empty."""
    name = fresh(docs, "score")
    return fit(docs, labels, doc_id=doc_id, text=text).score(docs, name, text).filter(F.col(name) >= threshold).drop(name)
