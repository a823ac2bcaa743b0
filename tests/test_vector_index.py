"""The inverted-file index: exact mode equals a full search, and the recall of probing is measured."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from korpusmill.functions.topk import Running
from korpusmill.operators import retrieval as R
from korpusmill.operators.vector_index import VectorIndex, recall


def rows(df):
    return sorted(map(tuple, df.collect()))


def clustered(spark, n=3000, groups=30, dims=16, crowded=0.4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    which = np.where(rng.random(n) < crowded, 0, rng.integers(0, groups, n))
    v = centres[which] + 0.15 * rng.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[n - 5 :] = v[0]  # ties
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(n, None)], "id long, vector array<double>")


@pytest.fixture(scope="module")
def supplied(spark, sf_dir, tmp_path_factory):
    e = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, e.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), VectorIndex.build(e, str(tmp_path_factory.mktemp("ivf")), target=0.97)


def test_exact_mode_equals_a_full_search(supplied):
    e, q, index = supplied
    for k, floor in ((5, None), (1, None), (12, 0.2)):
        want = rows(R.dense_topk(q, e, k, floor=floor))
        assert rows(index.search(q, k, exact=True, probes=2, floor=floor)) == want
        assert rows(index.search(q, k, exact=True, probes=3, floor=floor, broadcast_bytes=0)) == want  # queries joined by cell
    assert rows(index.search(q, 3, exact=True, skip_self=False)) == rows(R.dense_topk(q, e, 3, skip_self=False))


def test_recall_of_the_query_set(supplied):
    """Queries are the rows whose id is divisible by 50, against all rows."""
    e, q, index = supplied
    found = index.search(q, 5)
    got = recall(found, R.dense_topk(q, e, 5)).agg(F.avg("recall")).first()[0]
    assert got >= 0.9, got
    assert index.probes < len(index.centroids)
    assert rows(index.search(q, 5, broadcast_bytes=0)) == rows(found)


def test_clusters_need_few_probes(spark, tmp_path):
    e = clustered(spark)
    index = VectorIndex.build(e, str(tmp_path / "x"), rows_per_file=400)
    assert index.rows.sum() == 3000 and index.probes <= len(index.centroids) // 5
    q = e.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    want = R.dense_topk(q, e, 5)
    assert recall(index.search(q), want).agg(F.avg("recall")).first()[0] >= 0.9
    assert rows(index.search(q, exact=True)) == rows(want)
    read = index._planned(q.filter("vector is not null"), index.probes).agg(F.avg(F.size("cells"))).first()[0]
    assert read < len(index.centroids) / 4


def test_added_rows_are_found(spark, tmp_path):
    e = clustered(spark, 400, 6, 8)
    index = VectorIndex.build(e.filter("id < 300"), str(tmp_path / "x")).add(e.filter("id >= 300"))
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    assert index.rows.sum() == 400 and rows(index.search(q, exact=True)) == rows(R.dense_topk(q, e, 5))
    assert rows(VectorIndex.open(spark, index.path, index.probes).search(q)) == rows(index.search(q))


def test_edges(spark, tmp_path):
    e = clustered(spark, 40, 3, 4)
    empty = VectorIndex.build(e.limit(0), str(tmp_path / "a"))
    q = e.withColumnRenamed("id", "query_id")
    assert empty.search(q).collect() == [] == empty.search(q, exact=True).collect()
    one = VectorIndex.build(e.filter("id = 3"), str(tmp_path / "b"))
    assert [(r.query_id, r.id) for r in one.search(q.filter("query_id in (3, 4, 40)"), exact=True).collect()] == [(4, 3)]
    assert one.search(q.limit(0)).collect() == []
    names = VectorIndex.build(e.select(F.concat(F.lit("v"), "id").alias("id"), "vector", F.lit(1).alias("score")), str(tmp_path / "c"))
    found = names.search(q.select(F.concat(F.lit("v"), "query_id").alias("query_id"), "vector"), 2, exact=True)
    assert found.count() == 80 and found.filter("query_id = id").count() == 0


def test_running_best():
    rng = np.random.default_rng(2)
    best, scores = Running(7, 3, room=10), np.round(rng.random((7, 500)), 2)
    for i in range(0, 500, 50):
        best.offer(np.arange(7), scores[:, i : i + 50], pa.array(np.arange(i, i + 50)))
    out = pa.Table.from_batches(best.batches(pa.array(list("abcdefg")), ["q", "id", "s"])).to_pylist()
    want = {("abcdefg"[q], i, s) for q in range(7) for i, s in enumerate(scores[q]) if s >= np.sort(scores[q])[-3]}
    assert {(r["q"], r["id"], r["s"]) for r in out} == want
    assert list(Running(0, 3).batches(pa.array([]), ["q", "id", "s"])) == []
