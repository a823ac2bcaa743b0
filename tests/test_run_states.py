"""States of runs equal the aggregates of whole logs, whatever was added, changed and removed."""

import random

from pyspark.sql import functions as F

from korpusmill.operators import decisions as D
from korpusmill.operators import run_states
from korpusmill.operators.run_states import RunStates

SHAPE = "run_id string, entity string, doc_id string, decision string, minutes double, external boolean, note string"
KINDS = ["keep", "drop", "discard"]


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def some_log(seed, runs, n, n_docs):
    r = random.Random(seed)
    pick = lambda *x: r.choice([*x, None])
    return [(run, pick("a", "b", "c"), pick(*(f"d{r.randrange(n_docs)}" for _ in range(5))), pick("keep", "drop"), pick(1.5, 2.25), pick(True, False), "x") for run in runs for _ in range(n)]


def same(states, log):
    flags = ["external"]
    assert rows(states.entities()) == rows(D.aggregate_log(log, ["entity"], flags))
    assert rows(states.entities_by_run()) == rows(D.aggregate_log(log, ["run_id", "entity"], flags))
    assert rows(states.run_stats(KINDS)) == rows(D.run_stats(log, ["run_id"], KINDS))
    facts = D.recurrence_facts(log, "entity", F.col("external")).withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    assert rows(states.recurrence_facts("external")) == rows(facts)


def test_added_changed_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run_states, "FEW", 6)  # lists and bitmaps in one table
    made = lambda x: spark.createDataFrame(x, SHAPE)
    a, b, c = some_log(1, ["r1", "r2"], 60, 9), some_log(2, ["r3", None], 40, 30), some_log(3, ["r2"], 50, 40)
    states = RunStates(spark, str(tmp_path / "s"), "entity", ["external"], buckets=2).put(made(a))
    same(states, made(a))
    states = states.put(made(b))
    same(states, made(a + b))
    states = RunStates.open(spark, str(tmp_path / "s")).put(made(c))
    now = [x for x in a if x[0] != "r2"] + b + c
    same(states, made(now))
    kinds = states._live("pages").agg(F.count("few").alias("few"), F.count("bits").alias("bits")).first()
    assert kinds.few and kinds.bits
    states = states.drop(made([(None, *["x"] * 3, 1.0, True, "x")]))
    same(states, made([x for x in now if x[0] is not None]))
    assert rows(RunStates.open(spark, str(tmp_path / "s")).runs()) == rows(states.runs())


def test_numbers_stay(spark, tmp_path):
    """A document keeps its number, and no two have the same."""
    made = lambda docs: spark.createDataFrame([("r" + str(len(docs)), "e", d, "keep", 1.0, True, "") for d in docs], SHAPE)
    states = RunStates(spark, str(tmp_path / "s"), "entity", ["external"], buckets=3).put(made([f"d{i}" for i in range(50)]))
    first = {r.doc_id: r.number for r in states._table("docs", 1).collect()}
    states = states.put(made([f"d{i}" for i in range(30, 90)]))
    after = {r.doc_id: r.number for r in states._table("docs", 2).collect()}
    assert len(after) == len(set(after.values())) == 90 and first.items() <= after.items()
    assert states.entities().first().n_docs == 90


def test_broken_write_and_empty_log(spark, tmp_path, monkeypatch):
    log = spark.createDataFrame(some_log(4, ["r1", "r2"], 30, 9), SHAPE)
    path = str(tmp_path / "s")
    states = RunStates(spark, path, "entity", ["external"]).put(log)
    assert states.put(log.limit(0)) == states
    monkeypatch.setattr(run_states, "_point", lambda *a: 1 / 0)
    try:
        states.put(spark.createDataFrame(some_log(5, ["r2", "r9"], 30, 9), SHAPE))
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    again = RunStates.open(spark, path)
    same(again, log)
    more = some_log(6, ["r2", "r7"], 30, 12)
    same(again.put(spark.createDataFrame(more, SHAPE)), log.filter("run_id = 'r1'").unionByName(spark.createDataFrame(more, SHAPE)))


def test_old_runs_are_pruned(spark, tmp_path):
    """States of other versions are left out by their folders."""
    states = RunStates(spark, str(tmp_path / "s"), "entity", ["external"]).put(spark.createDataFrame(some_log(7, ["r1"], 30, 9), SHAPE)).put(spark.createDataFrame(some_log(8, ["r1"], 30, 9), SHAPE))
    plan = states.entities()._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "dynamicpruning" in plan.lower()
