"""What only shows on larger tables, made small: plans that size a table wrongly, and limits that are passed."""

import pytest
from pyspark.sql import functions as F

from korpusmill import plans
from korpusmill.operators import lexical_index as L
from korpusmill.operators import matching
from korpusmill.operators import retrieval as R
from korpusmill.sources import tables
from korpusmill.sources.buckets import BucketedTable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ledger_never_sends_the_grams_of_surfaces(spark, tmp_path):
    """A small file whose n-grams are many: Spark takes them for as small as the file."""
    spark.range(3000).select(F.col("id").alias("entry_id"), F.concat(F.lit("left part "), F.col("id") % 50, F.lit(" right")).alias("surface_form")).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([("a", "part 7"), ("b", "left"), ("c", "Right"), ("d", "nowhere"), ("e", "rt")], "page_id string, term string").write.parquet(str(tmp_path / "t"))
    entries, terms = spark.read.parquet(str(tmp_path / "e")), spark.read.parquet(str(tmp_path / "t"))
    want = sorted([(i, "a") for i in range(3000) if str(i % 50).startswith("7")] + [(i, p) for i in range(3000) for p in "bc"])
    for rows in (100_000, 0):  # terms sent, terms joined
        out = matching.ledger(entries, terms, broadcast_rows=rows)
        assert sorted(map(tuple, out.collect())) == want
        assert "BuildLeft" not in plan(out) and ("BroadcastExchange" in plan(out)) == (rows > 0)


def test_bucketed_table_with_ids_that_meet(spark, tmp_path):
    """An event of a table of over a million rows can have the number that a seen one gets; numbers can repeat."""
    rows = [(5, 1, "view"), (1_000_005, 2, "click"), (1_000_006, 3, "view"), (6, 4, "error"), (7, 5, "view"), (1_000_007, 6, "error"), (6, 4, "error"), (6, 7, "click")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, plans.QUERIES["s9_bucketed_table"](spark, str(tmp_path)).select("event_id", "user_id", "event_type").collect()))
    assert got == [(6, 4, "ERROR"), (6, 4, "ERROR"), (6, 7, "click"), (1_000_005, 1, "seen"), (1_000_005, 2, "click"), (1_000_007, 5, "seen"), (1_000_007, 6, "ERROR"), (2_000_006, 3, "seen")]


def test_replace_without_keys(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("v"))
    new = df.filter("v = 0").select((F.col("id") + 1).alias("id"), F.lit(9).cast("long").alias("v"))
    table = BucketedTable.create(df, str(tmp_path / "t"), ["id"], 4).replace_where(new.unionByName(new), F.col("v") == 0, by_key=False)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(table.read()) == rows(tables.replace_where(df, new.unionByName(new), F.col("v") == 0))
    once = rows(table.upsert(new.filter("id = 1")).read())
    assert [r for r in once if r[0] == 1] == [(1, 9)] and len(once) == table.read().count() - 2


def test_many_queries_do_not_emit_all_pairs(spark, monkeypatch):
    """Queries beyond the bound: what the searches pass on is some rows a query and group, not a row for each pair that shares a word."""
    monkeypatch.setattr(L, "PART_TOKENS", 64)
    monkeypatch.setattr(L, "GROUP_BYTES", 1 << 14)
    words = spark.range(400).select("id", F.explode(F.array(F.lit("the"), F.lit("of"), F.concat(F.lit("w"), F.col("id") % 37))).alias("token"), (1 / (F.col("id") % 11 + 2)).alias("weight"))
    asked = words.filter("id % 2 = 0").withColumnRenamed("id", "query_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.sparse_topk(asked, words, 3, broadcast_rows=5)) == rows(R.sparse_topk(asked, words, 3))
    found = L.LexicalIndex.of(words, 8).search(asked, 3, 5)
    assert "Generate explode(arrays_zip" not in plan(found) and found.count() < 200 * 400 / 2


@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_dense_candidates_are_few(spark, broadcast):
    """However many blocks a task reads, it passes on the k best of a query once."""
    e = spark.range(600).coalesce(1).select("id", F.array(*[F.sin(F.col("id") * 7 + F.lit(i)) for i in range(4)]).alias("vector"))
    q = e.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, R.dense_topk(q, e, 4).collect()))
    for most in (0, 200_000):
        out = R.dense_topk(q, e, 4, block=50, broadcast_bytes=broadcast, candidates=most)
        assert sorted(map(tuple, out.collect())) == want
        assert rows_of(out, "MapInArrow") < 200 * 4 * 3  # not 12 blocks of k


def rows_of(df, name):
    """Rows that the topmost operator of that name gave when ``df`` ran."""
    def walk(p):
        if name in p.nodeName():
            return p.metrics().apply("pythonNumRowsReceived").value()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if "QueryStage" in p.getClass().getSimpleName():
            return walk(p.plan())
        kids = p.children()
        return next((r for i in range(kids.size()) if (r := walk(kids.apply(i))) is not None), None)

    return walk(df._jdf.queryExecution().executedPlan())


def test_the_lanes_search_once(spark, sf_dir, monkeypatch):
    """Fusion and evaluation use the lexical lane two and four times; it is worked out once."""
    calls, real = [], R.sparse_topk
    monkeypatch.setattr(R, "sparse_topk", lambda *a, **k: calls.append(1) or real(*a, **k))
    for name in ("r8_rank_fusion", "r9_evaluation"):
        calls.clear()
        out = plans.QUERIES[name](spark, sf_dir)
        assert len(calls) == 1 and "LexicalIndex" not in plan(out) and "explode" not in plan(out)
