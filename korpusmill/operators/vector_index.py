"""An inverted-file index of vectors: rows in cells around centroids, so that a search reads the cells near its queries.

The centroids are fitted on a bounded sample; every row is in the index, in the cell of its nearest centroid, with its angle to
it. A search probes the nearest cells of each query, or, in exact mode, all cells that can still hold one of its k best: by the
triangle inequality of angles, no row of a cell is nearer to a query than the centroid's angle less the cell's radius.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from korpusmill.functions.batches import map_batches
from korpusmill.functions.checkpoints import cut
from korpusmill.functions.topk import Running
from korpusmill.operators.retrieval import dense_topk, top_k

MOST_CELLS = 4096


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors without nulls as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def centroids_of(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means from distinct rows of the sample; a cell that loses all rows takes the row that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    rows = np.unique(sample, axis=0)
    found = rows[rng.permutation(len(rows))[:cells]]
    for _ in range(rounds):
        score = sample @ found.T
        at = score.argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        empty = np.flatnonzero(np.bincount(at, minlength=len(found)) == 0)
        worst = np.argsort(score.max(axis=1), kind="stable")[: len(empty)]
        sums[empty[: len(worst)]] = sample[worst]
        found = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return found


@dataclass
class VectorIndex:
    """A stored index. ``radius`` is the greatest angle of a cell's rows to its centroid; a cell without rows is never probed."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    probes: int = 8

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int | None = None, most: int = 50_000, rows_per_file: int = 500_000, target: float = 0.95, seed: int = 7) -> VectorIndex:
        """Index ``corpus`` (``id``, ``vector`` of unit length, more columns are kept) below ``path``.

        Centroids are fitted on the at most ``most`` rows with the least hash of their id; there are as many as the square root
        of the rows by default, but 4,096 at the most and one for ten rows of the sample at least. A cell of more than
        ``rows_per_file`` rows is written by several tasks, so a crowded cell is no bottleneck. Rows without a vector are left
        out. The number of probes is set by :meth:`tune`.
        """
        spark, some = corpus.sparkSession, corpus.filter(F.col("vector").isNotNull())
        sample = matrix(some.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow().combine_chunks().column(0).combine_chunks())
        n = some.count()
        cells = min(cells or round(n**0.5), MOST_CELLS, max(1, len(sample) // 10))
        centroids = centroids_of(sample, cells, seed=seed) if len(sample) else np.zeros((0, 0))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        assigned = cls._assigned(some, centroids)
        spark.createDataFrame([(assigned.schema.json(),)], "value string").write.mode("overwrite").text(f"{path}/schema")  # an index without rows has no file that tells it
        cls._write(assigned, f"{path}/vectors", n, rows_per_file, "overwrite")
        index = cls.open(spark, path)
        if n:
            index.tune(target)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, probes: int = 8) -> VectorIndex:
        """The index at ``path``; counts and radii are aggregated from two narrow columns."""
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.cell)
        centroids = np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0))
        counts, radius = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        if rows:
            for r in cls(spark, path, centroids, counts, radius).vectors().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
                counts[r.cell], radius[r.cell] = r.n, r.r
        return cls(spark, path, centroids, counts, radius, probes)

    def add(self, rows: DataFrame) -> VectorIndex:
        """The index with more rows, appended to their cells; the centroids stay."""
        some = rows.filter(F.col("vector").isNotNull())
        self._write(self._assigned(some, self.centroids), f"{self.path}/vectors", 0, 500_000, "append")
        return VectorIndex.open(self.spark, self.path, self.probes)

    @staticmethod
    def _assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
        """``rows`` with ``cell`` and ``angle``."""
        shared, place = rows.sparkSession.sparkContext.broadcast(centroids), rows.columns.index("vector")  # at most MOST_CELLS vectors

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    score = matrix(b.column(place)) @ shared.value.T
                    cell = score.argmax(axis=1)
                    angle = np.arccos(np.clip(score[np.arange(len(cell)), cell], -1, 1))
                    yield pa.record_batch([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [*b.schema.names, "cell", "angle"])

        return map_batches(rows, run, StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())]))

    @staticmethod
    def _write(assigned: DataFrame, path: str, n: int, rows_per_file: int, mode: str) -> None:
        piece = F.pmod(F.xxhash64("id"), F.lit(max(1, n // rows_per_file)))  # a cell of all rows still spreads over that many tasks
        assigned.repartition("cell", piece).sortWithinPartitions("cell").write.mode(mode).partitionBy("cell").parquet(path)

    def vectors(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first().value))
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def tune(self, target: float = 0.95, k: int = 5, sample: int = 200) -> float:
        """Set ``probes`` to the least number with which ``sample`` rows find the share ``target`` of their exact k nearest; returns the share.

        One exact search over the whole index tells for each true neighbour how near its cell is to the query.
        """
        rows = self.vectors().select("id", "vector", "cell")
        asked = cut(rows.orderBy(F.xxhash64(F.lit("tune"), "id"), "id").limit(sample).select(F.col("id").alias("query_id"), "vector"))
        true = dense_topk(asked, rows.select("id", "vector"), k).join(rows.select("id", "cell"), "id").select("query_id", "cell")
        table = asked.toArrow().combine_chunks()
        order = self._nearest(matrix(table.column("vector").combine_chunks()))
        place = {q: {c: i for i, c in enumerate(o)} for q, o in zip(table.column("query_id").to_pylist(), order.tolist(), strict=True)}
        ranks = np.sort([place[r.query_id][r.cell] for r in true.collect()])  # k rows for each of the sample
        if not len(ranks):
            return 1.0
        need = int(np.ceil(target * len(ranks)))
        self.probes = int(ranks[max(need - 1, 0)]) + 1
        return float((ranks < self.probes).mean())

    def _nearest(self, queries: np.ndarray) -> np.ndarray:
        """Cells by their centroid's nearness to each query; those without rows last."""
        score = np.where(self.rows > 0, queries @ self.centroids.T, -np.inf)
        return np.argsort(-score, axis=1, kind="stable")

    def _planned(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id``, ``vector`` and the ``cells`` to read: the nearest ones, or with a column ``least`` all others that may hold a score of that or more."""
        if not len(self.centroids):
            return queries.select("query_id", "vector").withColumn("cells", F.array().cast("array<int>"))
        index = VectorIndex(None, self.path, self.centroids, self.rows, self.radius)
        shared, bounded = queries.sparkSession.sparkContext.broadcast(index), "least" in queries.columns

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
                v = matrix(b.column(1))
                near = x._nearest(v)
                chosen = np.zeros(near.shape, bool)
                np.put_along_axis(chosen, near[:, :probes], True, axis=1)
                if bounded:
                    angle = np.arccos(np.clip(v @ x.centroids.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), -1, 1))
                    best = np.cos(np.maximum(angle - x.radius - 1e-7, 0))  # of unit rows; scores are rounded to six digits
                    chosen = ~chosen & (best + 2e-6 >= b.column(2).to_numpy()[:, None])
                chosen &= x.rows > 0
                row, cell = np.nonzero(chosen)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(v)))]).astype(np.int32)
                yield pa.record_batch([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(cuts), pa.array(cell.astype(np.int32)))], ["query_id", "vector", "cells"])

        given = queries.select("query_id", "vector", *(["least"] if bounded else []))
        return map_batches(given, run, StructType([*given.schema.fields[:2], StructField("cells", ArrayType(IntegerType()))]))

    def _hits(self, planned: DataFrame, k: int, floor: float | None, skip_self: bool, broadcast_bytes: int) -> DataFrame:
        """Candidates from the cells that the queries plan to read: each task's k best, ties included."""
        corpus = self.vectors().select("id", "vector", "cell")
        out = StructType([StructField("query_id", planned.schema["query_id"].dataType), StructField("id", corpus.schema["id"].dataType), StructField("score", DoubleType())])
        size = planned.agg(F.sum(8 * F.size("vector") + 4 * F.size("cells")).alias("bytes")).first().bytes or 0
        least = -np.inf if floor is None else floor - 1e-12
        if size > broadcast_bytes:
            return self._joined(planned, corpus, k, least, skip_self, out)
        table = planned.toArrow().combine_chunks()
        if not table.num_rows:
            return self.spark.createDataFrame([], out)
        lists = table.column("cells").combine_chunks()
        cell, row = lists.values.to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(cell, kind="stable")
        readers = {int(c): r for c, r in zip(np.unique(cell), np.split(row[order], np.flatnonzero(np.diff(cell[order])) + 1), strict=True)} if len(cell) else {}
        ids = table.column("query_id").combine_chunks()
        shared = self.spark.sparkContext.broadcast((ids, matrix(table.column("vector").combine_chunks()), readers))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, queries, readers = shared.value
            best = Running(len(ids), k)
            for b in batches:
                cells = b.column(2).to_numpy(zero_copy_only=False)
                for c in np.unique(cells):
                    asked, rows = readers[int(c)], pa.array(np.flatnonzero(cells == c))
                    for i in range(0, len(rows), 2048):
                        these = rows[i : i + 2048]
                        names = b.column(0).take(these)
                        score = np.round(queries[asked] @ matrix(b.column(1).take(these)).T, 6)
                        if skip_self:
                            score[ids.take(pa.array(asked)).to_numpy(zero_copy_only=False)[:, None] == names.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                        best.offer(asked, score, names, least)
            yield from best.batches(ids, out.names)

        return map_batches(corpus.filter(F.col("cell").isin(list(readers))), run, out) if readers else self.spark.createDataFrame([], out)

    @staticmethod
    def _joined(planned: DataFrame, corpus: DataFrame, k: int, least: float, skip_self: bool, out: StructType) -> DataFrame:
        """The same for more queries than are sent to every task: blocks of a cell's queries meet blocks of its rows."""

        def packed(df: DataFrame, name: str, block: int = 2048) -> DataFrame:
            pair = StructType(df.schema.fields[:2])

            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    cells = b.column(2).to_numpy(zero_copy_only=False)
                    for c in np.unique(cells):
                        rows = pa.array(np.flatnonzero(cells == c))
                        for i in range(0, len(rows), block):
                            these = b.take(rows[i : i + block])
                            both = pa.StructArray.from_arrays(these.columns[:2], [f.name for f in pair.fields])
                            yield pa.record_batch([pa.array([int(c)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both)], ["cell", name])

            return map_batches(df, run, StructType([StructField("cell", IntegerType()), StructField(name, ArrayType(pair))]))

        asked = planned.select("query_id", "vector", F.explode("cells").alias("cell")).repartition("cell").sortWithinPartitions("cell")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for q, c in zip(b.column(0), b.column(1), strict=True):
                    (ids, queries), (names, rows) = q.values.flatten(), c.values.flatten()
                    score = np.round(matrix(queries) @ matrix(rows).T, 6)
                    if skip_self:
                        score[ids.to_numpy(zero_copy_only=False)[:, None] == names.to_numpy(zero_copy_only=False)[None, :]] = -np.inf
                    best = Running(len(ids), k)
                    best.offer(np.arange(len(ids)), score, names, least)
                    yield from best.batches(ids, out.names)

        return map_batches(packed(corpus, "c").join(packed(asked, "q"), "cell").select("q", "c"), run, out)

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, exact: bool = False, floor: float | None = None, skip_self: bool = True, broadcast_bytes: int = 32 << 20) -> DataFrame:
        """``query_id``, ``id``, ``score`` and ``rank`` of the k nearest rows of each query (``query_id``, ``vector``), equal scores by id.

        By default a query sees the rows of its ``probes`` nearest cells only. With ``exact`` its first k best set a bound, and
        the other cells that may hold a row as near are read as well; the result is that of a search through all rows. Queries
        of at most ``broadcast_bytes`` are sent to the tasks; more are joined with the rows by cell. Either way only the cells
        that some query reads are scanned. Queries without a vector are left out.
        """
        asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
        first = top_k(self._hits(self._planned(asked, probes or self.probes), k, floor, skip_self, broadcast_bytes), ["query_id"], "score", k, "id")
        if not exact:
            return first
        first = cut(first)
        bound = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        rest = asked.join(bound, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0 if floor is None else floor)))
        more = self._hits(self._planned(rest, probes or self.probes), k, floor, skip_self, broadcast_bytes)
        return top_k(first.drop("rank").unionByName(more), ["query_id"], "score", k, "id")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query of ``exact`` the share of its rows that ``found`` has too (0 to 1)."""
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("_in")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.round(F.count("_in") / F.count("*"), 6).alias("recall"))
