"""The stages of the pipeline on small tables, each against brute force."""

import math
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_shingle_dedup import brute_groups


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen.append((before, docs))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen[0][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) / len(good) > 0.95

    roots = brute_groups({r.doc_id: r.text for r in seen[1][0].collect()})
    assert sorted(r.doc_id for r in seen[1][1].collect()) == sorted(set(roots.values()))

    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = seen[2][1].collect()
    assert not any(t in r.text for r in left for t in items)
    gone = {r.doc_id for r in seen[2][0].collect()} - {r.doc_id for r in left}
    assert len(gone) < 0.2 * seen[2][0].count()

    n = Counter(r.doc_id for r in seen[3][1].collect())
    assert set(n) <= {r.doc_id for r in left} and abs(sum(n.values()) - len(left)) < 4 * math.sqrt(len(left)) + 20
    out = seen[4][1].collect()
    assert Counter(r.doc_id for r in out) == n
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_edges(spark, sf_dir):
    """Null texts, ids and sources, repeated rows and columns that the stages use themselves go through; so does an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    some = docs.filter("text is not null").orderBy("doc_id").limit(60)
    odd = some.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    empty = some.limit(1).withColumn("doc_id", F.lit(10**9).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(""))
    table = some.unionByName(some.limit(3)).unionByName(odd).unionByName(odd).unionByName(empty)
    table = table.withColumns({c: F.lit("mine") for c in ("copy", "shard", "slot", "h", "fp")})
    ids = {r.doc_id for r in table.collect()}
    for start in (table, table.limit(0)):
        now = start
        for i, (_, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, sf_dir)
            rows = now.collect()
            assert {r.doc_id for r in rows} <= ids and set(columns) <= set(now.columns)
            if i in (0, 1, 2):
                assert now.columns == start.columns and all(r.shard == "mine" for r in rows)
            now = spark.createDataFrame(rows, now.schema)
        assert (len(rows) > 0) == (start is table) and all(r.h == "mine" and 0 <= r.shard < 16 for r in rows)
