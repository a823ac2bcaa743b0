"""Quality rules: counts of the whole text, and a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.llm.common import SPACE, SpanHash, scramble, slices, utf8, words
from korpusmill.llm.labelled import Adam, labelled_sample, sigmoid, split

#: Hashed words and word pairs share one table of weights, runs of three and four characters another.
WORDS = CHARS = 4096
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)
#: Leaves as many high bits as CHARS needs.
_SHIFT = np.uint64(64 - (CHARS - 1).bit_length())
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def characters(data: np.ndarray) -> np.ndarray:
    """A number for each character of UTF-8 text: its bytes, the first in the lowest place."""
    more = np.concatenate([(data & 0xC0) == 0x80, np.zeros(3, bool)])
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    lead = np.flatnonzero(~more[: len(data)])
    out, inside = padded[lead].astype(np.uint64), np.ones(len(lead), bool)
    for j in range(1, 4):
        inside &= more[lead + j]
        out |= np.where(inside, padded[lead + j], 0).astype(np.uint64) << np.uint64(8 * j)
    return out


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal in their row, and which are not the first of their equals."""
    key = scramble(h + scramble(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def analyse(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Counts of each text (columns as COUNTS), then buckets and rows of the word features and of the character features."""
    n, size = len(offsets) - 1, len(data)
    start, end, row = words(data, offsets)
    spans = SpanHash(data)
    h = spans(start, end)
    byte_row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    n_words = np.bincount(row, minlength=n)
    chars = np.bincount(byte_row[~SPACE[data] & ((data & 0xC0) != 0x80)], minlength=n)
    symbols = np.bincount(byte_row[_SYMBOL[data]], minlength=n)

    breaks = np.flatnonzero(data == 10)
    owner = byte_row[breaks]
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(n), owner])
    order = np.lexsort((np.concatenate([np.zeros(n, np.int8), np.ones(len(breaks), np.int8)]), line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.append(line_start[1:] - 1, size)
    last = np.append(line_row[1:] != line_row[:-1], True)
    line_end[last] = offsets[line_row[last] + 1]
    inked = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end, line_row = line_start[inked], line_end[inked], line_row[inked]
    dup_lines = np.bincount(line_row[_repeats(line_row, spans(line_start, line_end))[1]], minlength=n)

    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(row[2:] == row[:-2])
        mixed = scramble(scramble(scramble(h[inside]) + h[inside + 1]) + h[inside + 2])
        for j in inside[_repeats(row[inside], mixed)[0]][None, :] + np.arange(3)[:, None]:
            covered[j] = True
    repeat = np.bincount(row[covered], minlength=n)

    pair = np.flatnonzero(row[1:] == row[:-1])
    word_bucket = np.concatenate([h, scramble(h[pair] * _TIMES + h[pair + 1])]) & np.uint64(WORDS - 1)
    word_row = np.concatenate([row, row[pair]])
    char, char_row = characters(data), byte_row[(data & 0xC0) != 0x80]
    grams, gram_rows = [], []
    for width in (3, 4):
        if len(char) >= width:
            g = np.zeros(len(char) - width + 1, np.uint64)
            for j in range(width):
                g = (g ^ char[j : len(g) + j]) * _TIMES
            ok = char_row[: len(g)] == char_row[width - 1 :]
            grams.append((g[ok] >> _SHIFT).astype(np.int32))
            gram_rows.append(char_row[: len(g)][ok])
    counts = np.column_stack([n_words, chars, symbols, dup_lines, repeat]).astype(np.int64)
    none = [np.zeros(0, np.int32)]
    return counts, (word_bucket.astype(np.int64), word_row), (np.concatenate(grams or none), np.concatenate(gram_rows or none))


def base_failed(counts: np.ndarray) -> np.ndarray:
    n_words, repeat = counts[:, 0], counts[:, 4]
    return (n_words < 50) | (100 * repeat > 50 * n_words)


@dataclass
class NgramModel:
    """Weights of the hashed n-grams, an intercept, and the line that calibrates the logit."""

    words: np.ndarray
    chars: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probabilities(self, n: int, word: tuple[np.ndarray, np.ndarray], char: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """An n-gram counts by its share of the n-grams of its kind in the text."""
        logit = np.full(n, self.bias)
        for weights, (bucket, row) in ((self.words, word), (self.chars, char)):
            logit += np.bincount(row, weights[bucket], n) / np.maximum(np.bincount(row, minlength=n), 1)
        return sigmoid(self.slope * logit + self.shift)


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of each labelled text as sparse vectors."""
    for b in slices(batches):
        _, word, char = analyse(*utf8(b.column(1)))
        n = b.num_rows
        at, value, row = [], [], []
        for (bucket, r), base, width in ((word, 0, WORDS), (char, WORDS, CHARS)):
            key, count = np.unique(r.astype(np.int64) * width + bucket, return_counts=True)
            at.append(key % width + base)
            row.append(key // width)
            value.append(count / np.bincount(r, minlength=n)[key // width])
        at, value, row = (np.concatenate(x) for x in (at, value, row))
        order = np.argsort(row, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order].astype(t))) for x, t in ((at, np.int32), (value, np.float32))]
        yield pa.record_batch([b.column(0), *lists, b.column(2)], ["id", "at", "value", "label"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 4_000, doc_id: str = "doc_id", text: str = "text", epochs: int = 30, seed: int = 10) -> NgramModel:
    """Logistic regression on at most ``most`` labelled rows outside the held-out fold; a fifth of them calibrates it.

    Without labelled rows of both kinds the model gives every text the smoothed share of label 1.
    """
    sample = labelled_sample(docs, labels, most, doc_id=doc_id, text=text)
    rows = map_batches(sample, _features, f"id {sample.schema['id'].dataType.simpleString()}, at array<int>, value array<float>, label int").toArrow().combine_chunks()
    y = rows.column("label").to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2 or len(y) < 10:
        p = (y.sum() + 1) / (len(y) + 2)
        return NgramModel(np.zeros(WORDS), np.zeros(CHARS), float(np.log(p / (1 - p))))
    lists = rows.column("at").combine_chunks()
    cuts = lists.offsets.to_numpy().astype(np.int64)
    at, value = lists.values.to_numpy(), rows.column("value").combine_chunks().values.to_numpy()
    order = np.lexsort((np.diff(cuts), np.array(rows.column("id").to_pylist())))  # the same order on every run
    train, held = (order[k] for k in split(len(y), 0.2, seed))

    def sums(k: np.ndarray, x: np.ndarray) -> np.ndarray:
        i = np.concatenate([np.arange(cuts[j], cuts[j + 1]) for j in k])
        return np.bincount(at[i], x[i], WORDS + CHARS) / len(k)

    spread = np.sqrt(np.maximum(sums(train, value.astype(np.float64) ** 2) - sums(train, value) ** 2, 0))
    scale = (1 / (spread + 1e-4)).astype(np.float32)  # rare n-grams stay small

    def dense(k: np.ndarray) -> np.ndarray:
        x = np.zeros((len(k), WORDS + CHARS), np.float32)
        for i, j in enumerate(k):
            x[i, at[cuts[j] : cuts[j + 1]]] = value[cuts[j] : cuts[j + 1]]
        return x * scale

    weights, bias = np.zeros(WORDS + CHARS, np.float32), np.zeros(1, np.float32)
    adam, rng = Adam([weights, bias], 2e-3), np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = rng.permutation(train)
        for i in range(0, len(shuffled), 128):  # a batch at a time is dense
            k = shuffled[i : i + 128]
            x = dense(k)
            g = (sigmoid(x @ weights + bias) - y[k]) / len(k)
            adam.step([x.T @ g + 1e-4 * weights, g.sum(keepdims=True)])
    logit = np.concatenate([dense(held[i : i + 128]) @ weights for i in range(0, len(held), 128)]) + bias
    line = np.array([1.0, 0.0])
    for _ in range(25):  # Newton steps for slope and shift
        p = sigmoid(line[0] * logit + line[1])
        z = np.column_stack([logit, np.ones(len(held))])
        target = (y[held] * (y[held].sum() + 1) + (1 - y[held])) / np.where(y[held] == 1, y[held].sum() + 2, (1 - y[held]).sum() + 2)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - target))
        line -= np.clip(step, -1, 1)
    theta = weights * scale
    return NgramModel(theta[:WORDS].astype(np.float64), theta[WORDS:].astype(np.float64), float(bias[0]), max(float(line[0]), 1e-3), float(line[1]))


def apply_rules(docs: DataFrame, model: NgramModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` with the counts (see COUNTS), ``base_failed``, ``probability`` and ``kept``.

    A text is kept if no base rule fails (50 words at least, at most half of them in repeated three-word windows) and its
    probability of good quality is ``threshold`` or more. Null and empty texts have no words and fail; columns of ``docs``
    with these names are replaced; an empty table gives an empty result.
    """
    names = [*COUNTS, "base_failed", "probability", "kept"]
    docs = docs.drop(*names)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            counts, word, char = analyse(*utf8(b.column(place)))
            p, failed = shared.value.probabilities(b.num_rows, word, char), base_failed(counts)
            more = [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
            yield pa.record_batch([*b.columns, *more], [*b.schema.names, *names])

    types = [LongType()] * len(COUNTS) + [BooleanType(), DoubleType(), BooleanType()]
    return map_batches(docs, run, StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, types, strict=True))]))


def rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`apply_rules` with a model fitted on ``labels``."""
    return apply_rules(docs, fit(docs, labels, doc_id=doc_id, text=text), threshold, text)


def kept_only(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that :func:`rules` keeps, with the same columns; null, empty and short texts go, each of several equal rows is judged alike, and an empty table stays empty."""
    return rules(docs, labels, threshold).filter(F.col("kept")).select(*docs.columns)
