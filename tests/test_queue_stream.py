"""The queue as a stateful stream against the batch fold: restarts, late events and timers."""

import datetime as dt
import time

from pyspark.sql import functions as F

from korpusmill.operators import projects
from korpusmill.streaming import queue

SCHEMA = "key int, at timestamp, seq long, event string"
T0 = dt.datetime(2024, 1, 1)


def put(spark, tmp_path, rows):
    spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), i, e) for i, (k, s, e) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def run(spark, tmp_path, **more):
    states = queue.queue_states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **more)
    queue.start_queue(states, str(tmp_path / "out"), str(tmp_path / "ck"), by_clock="late" not in more).awaitTermination(120)
    return {r.key: (r.state, r.retries, r.wait_s, r.ready) for r in queue.read_queue(spark, str(tmp_path / "out")).collect()}


def test_equal_to_the_batch_fold(spark, sf_dir, tmp_path):
    """Events in three batches, out of order between them, with a restart after each."""
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "fail").when((F.col("event_type") == "signup") & (F.col("value") > 45), "cancel").otherwise("other")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("int").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), kind.alias("event"))
    for k in (2, 0, 1):  # the last third first
        events.filter(F.pmod(F.xxhash64("seq"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = run(spark, tmp_path)
    want = {r.key: (r.state, r.retries) for r in projects.fold_states(events, "key", ["at", "seq"], "event").collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3


def test_timers_by_event_time(spark, tmp_path):
    """A request is pending again 60, 300 and 900 seconds after its first, second and third failure; a fourth ends it."""
    clock = lambda s: put(spark, tmp_path, [(99, s, "other")])  # noqa: E731  another request's events move the watermark
    now, waits = 0, (60, 300, 900)
    for k, wait in enumerate(waits):
        put(spark, tmp_path, [(1, now, "start"), (1, now, "fail")])
        assert run(spark, tmp_path, late="0 seconds")[1] == ("pending", k + 1, wait, False)
        clock(now + wait - 1)
        assert run(spark, tmp_path, late="0 seconds")[1][3] is False
        clock(now + wait + 1)
        assert run(spark, tmp_path, late="0 seconds")[1] == ("pending", k + 1, wait, True)
        now += wait + 2
    put(spark, tmp_path, [(1, now, "start"), (1, now, "fail")])
    assert run(spark, tmp_path, late="0 seconds")[1] == ("failed", 4, None, False)


def test_timers_by_the_clock(spark, tmp_path):
    put(spark, tmp_path, [(1, 0, "start"), (1, 1, "fail"), (2, 0, "start"), (2, 1, "fail"), (3, 0, "cancel"), (4, 0, "other")])
    states = queue.queue_states(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), back_off=(4, 9, 9))
    stream = queue.start_queue(states, str(tmp_path / "out"), str(tmp_path / "ck"), every="1 second")
    read = lambda: {r.key: (r.state, r.ready) for r in queue.read_queue(spark, str(tmp_path / "out")).collect()}
    try:
        seen, end = [], time.time() + 90
        while time.time() < end and not (seen and seen[-1][1] == ("pending", True)):
            if list((tmp_path / "out").glob("batch=*/_SUCCESS")):
                seen.append(read())
            time.sleep(0.5)
    finally:
        stream.stop()
    assert any(s[1] == ("pending", False) for s in seen)
    assert seen[-1] == {1: ("pending", True), 2: ("pending", True), 3: ("cancelled", False), 4: ("pending", True)}


def test_a_start_ends_the_wait(spark, tmp_path):
    put(spark, tmp_path, [(1, 0, "start"), (1, 1, "fail"), (1, 2, "start")])
    assert run(spark, tmp_path, late="0 seconds")[1] == ("processing", 1, None, False)
    put(spark, tmp_path, [(9, 500, "other")])
    assert run(spark, tmp_path, late="0 seconds")[1] == ("processing", 1, None, False)


def test_rates_with_late_events(spark, tmp_path):
    """Events out of order by less than the bound count, by more they are left out and told; nothing is kept by the driver."""
    from korpusmill.streaming import incremental as I

    schema = "event_id int, event_type string, ts timestamp, value double"
    hours = [[0, 1, 30, 50], [49, 26, 2, 52], [3, 47, 75]]  # the watermark follows ten hours behind the newest before each file
    counted, newest, want = 0, -(10**6), {}
    for k, file in enumerate(hours):
        spark.createDataFrame([(h, "a", T0 + dt.timedelta(hours=h), 1.0) for h in file], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for h in file:
            day = h // 24
            if 24 * (day + 1) > newest - 10:  # its window is still open
                want[day] = want.get(day, 0) + 1
            else:
                counted += 1
        newest = max(newest, *file)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        told = I.stream_rates(I.event_rates(stream, "1 day", late="10 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert told == {0: 0, 1: 1, 2: 1}[k], (k, told)
    assert counted == 2 and {(r.start - T0).days: r.n for r in I.read_rates(spark, str(tmp_path / "out")).collect()} == want
