"""Embedders and re-rankers as columns: one set-up a worker, batches of a given size, defined results for nulls and no rows."""

import os

import numpy as np
from pyspark.sql import functions as F

from korpusmill.functions import providers, vectors
from korpusmill.operators import retrieval as R


def test_one_set_up_a_worker(spark, tmp_path):
    log = str(tmp_path / "log")

    def make():
        import os

        class Stub:
            dims = 3

            def __init__(self):
                with open(f"{log}-{os.getpid()}", "a") as f:
                    f.write("made\n")

            def embed(self, texts):
                with open(f"{log}-{os.getpid()}", "a") as f:
                    f.write(f"{len(texts)}\n")
                return [[len(t), 0, 1] for t in texts]

        return Stub()

    embed = providers.embedder(spark, make, batch=10)
    docs = spark.createDataFrame([(i, None if i == 7 else "x" * (i % 5)) for i in range(500)], "id int, text string").repartition(16)
    for _ in range(2):  # many tasks, two jobs
        got = {r.id: r.v for r in docs.select("id", embed(F.col("text")).alias("v")).collect()}
    assert got[7] is None and got[5] == [0.0, 0.0, 1.0] and all(got[i] == [i % 5, 0.0, 1.0] for i in got if i != 7)
    logs = [(tmp_path / n).read_text().split() for n in os.listdir(tmp_path)]
    assert logs and all(x.count("made") == 1 for x in logs)
    assert max(int(n) for x in logs for n in x if n != "made") <= 10
    none = docs.limit(0).select(embed(F.col("text")).alias("v"))
    assert none.collect() == [] and none.schema["v"].dataType.simpleString() == "array<double>"


def test_no_texts_keep_the_dimension():
    assert providers.embed_all(providers.HashEmbedder(5), []).shape == (0, 5)
    assert providers.embed_all(providers.HashEmbedder(5), ["a", "", "b c"], batch=2).shape == (3, 5)


def test_provider_equals_the_column(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    both = docs.select(vectors.hash_embedding(F.col("text")).alias("a"), providers.embedder(spark, providers.HashEmbedder)(F.col("text")).alias("b")).collect()
    assert both and all(np.allclose(r.a, r.b) for r in both)


def test_reranker(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, "a b c", "c d"), (1, 11, 0.8, "a b c", "A, b!"), (1, 12, 0.7, "a b c", None), (2, 10, 0.5, None, "x")], "query_id int, id int, score double, q string, t string").withColumn("rank", F.lit(0))
    score = providers.reranker(spark, providers.OverlapReranker, batch=2)(F.col("q"), F.col("t"))
    by_model = R.rerank(hits, score, 2).select("query_id", "id", "score", "rank")
    want = R.rerank(hits, R.overlap(F.col("q"), F.col("t")), 2).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, by_model.collect())) == sorted(map(tuple, want.collect())) and by_model.count() == 3
