"""The best rows of many queries, kept while a task reads on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


class Running:
    """The k best scores of each of ``n`` queries so far, with all that tie with the last of them.

    Memory is some k rows a query: what is offered is cut down whenever it has grown by as much again. ``floor`` holds the
    k-th score of each query that has k, by which callers may leave out work.
    """

    def __init__(self, n: int, k: int, slack: float = 0.0, room: int = 1 << 18):
        self.n, self.k, self.slack, self.room = n, k, slack, max(room, 4 * n * k)
        self.floor = np.full(n, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def offer(self, which: np.ndarray, scores: np.ndarray, ids: pa.Array, least: float = -np.inf) -> None:
        """Scores of queries ``which`` (rows) for ``ids`` (columns); those of -inf or below ``least`` are no hits."""
        if not scores.size:
            return
        k = max(0, scores.shape[1] - self.k)
        bar = np.maximum(np.partition(scores, k, axis=1)[:, k], self.floor[which])
        at = np.nonzero((scores >= bar[:, None] - self.slack) & (scores >= least) & np.isfinite(scores))
        self.add(which[at[0]], scores[at], ids.take(pa.array(at[1])))

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.parts.append((query, score, ids))
        self.held += len(query)
        if self.held > self.room:
            self._fold()

    def _fold(self) -> None:
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        order = np.lexsort((-score, query))
        count = np.bincount(query, minlength=self.n)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        full = np.flatnonzero(count >= self.k)
        self.floor[full] = score[order][first[full] + self.k - 1]
        kept = np.flatnonzero(score >= self.floor[query] - self.slack)
        self.parts = [(query[kept], score[kept], pa.concat_arrays([p[2] for p in self.parts]).take(pa.array(kept)))]
        self.held = len(kept)
        self.room = max(self.room, 2 * self.held)  # ties may be many

    def settle(self) -> None:
        """Bring ``floor`` up to date."""
        if self.parts:
            self._fold()

    def batches(self, names: pa.Array, columns: list[str]) -> Iterator[pa.RecordBatch]:
        """What is left, the queries by their ``names``."""
        self.settle()
        if self.parts:
            query, score, ids = self.parts[0]
            yield pa.record_batch([names.take(pa.array(query)), ids, pa.array(score)], columns)
