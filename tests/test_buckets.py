"""The bucketed table against the plain upsert: only touched buckets are written, and a write that breaks off changes nothing."""

import pytest
from pyspark.sql import functions as F

from korpusmill.sources import tables
from korpusmill.sources.buckets import BucketedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("v=*/**/*.parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7).cast("int").alias("at"), F.lit("old").alias("v"))
    return df, BucketedTable.create(df, str(tmp_path / "t"), ["key"], 16), tmp_path / "t"


def test_upsert_writes_only_touched_buckets(spark, stored):
    df, table, path = stored
    new = spark.createDataFrame([("k5", 9, "new"), ("k5", 9, "newer"), ("fresh", 1, "new")], "key string, at int, v string")
    before = files(path)
    after = table.upsert(new)
    assert rows(after.read()) == rows(tables.upsert(df, new, ["key"])) == rows(BucketedTable.open(spark, str(path)).read())
    now = files(path)
    assert {k: v for k, v in now.items() if k in before} == before  # nothing old is written again
    touched = {k.split("/")[1] for k in set(now) - set(before)}
    assert 1 <= len(touched) <= 2 and len(after.versions) == 16
    assert rows(table.read()) == rows(df)  # the version that was opened stays readable
    again = after.upsert(new)
    assert rows(again.read()) == rows(after.read())
    assert after.upsert(new.limit(0)) is after


def test_order_and_replace(spark, stored):
    df, table, path = stored
    new = spark.createDataFrame([("k1", 0, "late"), ("k1", 5, "kept"), ("k2", 1, "late"), ("n", None, "x"), (None, 1, "no key")], "key string, at int, v string")
    assert rows(table.upsert(new, ["at"]).read()) == rows(tables.upsert(df, new, ["key"], ["at"]))
    table = BucketedTable.create(df, str(path) + "2", ["key"], 16)
    add = spark.createDataFrame([("z", 3, "added")], "key string, at int, v string")
    assert rows(table.replace_where(add, F.col("at") == 3).read()) == rows(tables.replace_where(df, add, F.col("at") == 3))
    assert rows(table.replace_where(add.limit(0), F.lit(True)).read()) == []


def test_a_write_that_breaks_off(spark, stored, monkeypatch):
    df, table, path = stored
    new = spark.createDataFrame([("k5", 9, "new")], "key string, at int, v string")

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr("korpusmill.sources.buckets._point", broken)
    with pytest.raises(RuntimeError):
        table.upsert(new)
    assert rows(BucketedTable.open(spark, str(path)).read()) == rows(df)
    monkeypatch.undo()
    assert rows(BucketedTable.open(spark, str(path)).upsert(new).read()) == rows(tables.upsert(df, new, ["key"]))


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "key string, at int")
    table = BucketedTable.create(none, str(tmp_path / "t"), ["key"])
    assert table.read().collect() == [] and BucketedTable.open(spark, str(tmp_path / "t")).read().columns == ["key", "at"]
    assert rows(table.upsert(spark.createDataFrame([("a", 1)], "key string, at int")).read()) == [("a", 1)]
