"""Range digests: equal to the full comparison, and only ranges that differ are read."""

import shutil

from pyspark.sql import functions as F

from korpusmill.operators import graph, patches
from korpusmill.sources.ranges import RangeSnapshot, changed_ranges, changes


def status(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_equals_the_full_report(spark, tmp_path):
    rows = spark.range(4_000).select(F.format_string("k%05d", "id").alias("key"), F.md5(F.col("id").cast("string")).alias("body"), F.lit(1).alias("h"))
    first, n = F.col("key") < "k00040", F.substring("key", 5, 2).cast("int")
    late = rows.filter(~(first & (n % 4 == 0))).withColumn("body", F.when(first & (n % 4 == 1), F.lit(None).cast("string")).when(first & (n % 4 == 2), F.lit("")).otherwise(F.col("body")))
    late = late.unionByName(spark.createDataFrame([("a", "before all", 1), ("z", "after all", 1), ("k00040x", None, 1)], "key string, body string, h int"))
    a = RangeSnapshot.write(rows, str(tmp_path / "a"), "key", "body", ranges=64)
    b = RangeSnapshot.write(late, str(tmp_path / "b"), "key", "body", like=RangeSnapshot.open(spark, str(tmp_path / "a")))
    want = status(patches.change_report(rows, late, "key", "body"))
    assert status(changes(a, b, unchanged=True)) == want and {s for _, s in want} == {"new", "changed", "gone", "unchanged"}
    assert status(changes(a, b)) == [x for x in want if x[1] != "unchanged"]
    hit = changed_ranges(a, b)
    assert 0 < len(hit) <= 4  # a hundredth of the keys, of 64 ranges
    assert "body" not in changes(a, b)._jdf.queryExecution().executedPlan().toString()
    for s in (a, b):  # the others are not needed at all
        for place in (tmp_path / s.path.split("/")[-1] / "rows").glob("range=*"):
            if int(place.name.split("=")[1]) not in hit:
                shutil.rmtree(place)
    assert status(changes(a, b)) == [x for x in want if x[1] != "unchanged"]


def test_same_empty_and_null(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 100_000)], "id long, text string")
    a = RangeSnapshot.write(rows, str(tmp_path / "a"), "id", "text")
    b = RangeSnapshot.write(rows.orderBy(F.desc("id")), str(tmp_path / "b"), "id", "text", like=a)
    assert changed_ranges(a, b) == [] and changes(a, b).count() == 0
    assert status(changes(a, b, unchanged=True)) == [(i, "unchanged") for i in (1, 2, 3)]
    none = RangeSnapshot.write(rows.limit(0), str(tmp_path / "c"), "id", "text", like=a)
    assert status(changes(a, none)) == [(i, "gone") for i in (1, 2, 3)] and status(changes(none, a)) == [(i, "new") for i in (1, 2, 3)]
    empty = RangeSnapshot.write(rows.limit(0), str(tmp_path / "d"), "id", "text")
    assert changes(empty, none).count() == 0
    full = RangeSnapshot.write(rows, str(tmp_path / "e"), "id", "text", like=empty)
    assert status(changes(empty, full)) == [(i, "new") for i in (1, 2, 3)]


def test_walk_splits_hubs(spark):
    """A hub's edges are in several tasks, and the rows are those of the plain walk."""
    n = 20_000
    spokes = spark.range(n).select(F.lit("hub").alias("from_page_id"), F.concat(F.lit("p"), "id").alias("to_page_id"))
    back = spark.createDataFrame([("s1", "hub"), ("s2", "hub"), ("p7", "s1"), ("p8", "end"), ("s1", None), (None, "s1")], "from_page_id string, to_page_id string")
    edges = spokes.unionByName(back).withColumn("type", F.lit("t")).withColumn("weight", F.lit("strong"))
    seeds = spark.createDataFrame([("s1",), ("s2",), ("s1",), (None,)], "page_id string")
    got = {(r.seed, r.page_id): r.hops for r in graph.walk(edges, seeds, 9, hub=500).collect()}
    want = {(s, f"p{i}"): 2 for s in ("s1", "s2") for i in range(n)} | {(s, s): 0 for s in ("s1", "s2", None)} | {(s, "hub"): 1 for s in ("s1", "s2")}
    want |= {("s1", None): 1, ("s2", None): 4, ("s1", "end"): 3, ("s2", "end"): 3, ("s2", "s1"): 3}
    assert got == want
    assert got == {(r.seed, r.page_id): r.hops for r in graph.walk(edges, seeds, 9).collect()}
