"""The work queue as a stateful stream: states that wait, and timers that bring a request back after a failure."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from korpusmill.functions.batches import ship
from korpusmill.operators.projects import BACK_OFF
from korpusmill.sources.tables import latest

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("done", "failed", "cancelled")


def step(state: str, tries: int, event: str, retries: int) -> tuple[str, int]:
    """The state and the failures so far after an event; the same steps as :func:`korpusmill.operators.projects.fold_states`."""
    if state in ENDED:
        return state, tries
    if event == "cancel":
        return "cancelled", tries
    if event == "start" and state == "pending":
        return "processing", tries
    if event == "done" and state == "processing":
        return "done", tries
    if event == "fail" and state == "processing":
        return ("failed" if tries + 1 > retries else "pending"), tries + 1
    return state, tries


class QueueProcessor(StatefulProcessor):
    """One request: its state as a value, its events as a list, and a timer while it waits after a failure.

    An event that is older than one that has been seen makes the state of the whole list anew, so the result does not depend
    on the order in which events arrive. Events of one request are few: a start and an end for each try.
    """

    def __init__(self, key: StructField, retries: int, back_off: tuple[int, ...], by_event_time: bool):
        self.key, self.retries, self.back_off, self.by_event_time = key.name, retries, back_off, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, tries int, last_at long, last_seq long, due long, version long, n long")
        self.events = handle.getListState("events", "at long, seq long, event string")

    def _told(self, key: tuple, state: str, tries: int, due: int, version: int, n: int) -> Row:
        waits = self.back_off[min(tries, len(self.back_off)) - 1] if state == "pending" and tries else None
        return Row(**{self.key: key[0], "state": state, "retries": tries, "wait_s": waits, "ready": state == "pending" and due == 0, "n_events": n, "version": version})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = sorted((r["at_us"], r["seq"], r["event"]) for r in rows)
        state, tries, last_at, last_seq, due, version, n = self.now.get() if self.now.exists() else ("pending", 0, -(1 << 62), 0, 0, 0, 0)
        if new[0][:2] < (last_at, last_seq):  # late: from the beginning
            todo = sorted([*((e[0], e[1], e[2]) for e in self.events.get()), *new])
            state, tries, failed_at = "pending", 0, None
        else:
            todo, failed_at = new, None
        self.events.appendList(new)
        before = (state, tries)
        for at, _, event in todo:
            was = (state, tries)
            state, tries = step(state, tries, event, self.retries)
            if tries > was[1]:
                failed_at = at
        if before != (state, tries) or failed_at is not None:
            if due:
                self.handle.deleteTimer(due)
            due = 0
            if state == "pending" and tries:
                wait = 1000 * self.back_off[min(tries, len(self.back_off)) - 1]
                due = (failed_at // 1000 if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()) + wait
                self.handle.registerTimer(due)
        version, n = version + 1, n + len(new)
        self.now.update((state, tries, max(last_at, todo[-1][0]), todo[-1][1] if todo[-1][0] >= last_at else last_seq, due, version, n))
        yield self._told(key, state, tries, due, version, n)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, tries, last_at, last_seq, due, version, n = self.now.get()
        if state == "pending" and due == expiredTimerInfo.getExpiryTimeInMs():
            self.now.update((state, tries, last_at, last_seq, 0, version + 1, n))
            yield self._told(key, state, tries, 0, version + 1, n)

    def close(self) -> None:
        pass


def queue_states(
    events: DataFrame, key: str = "key", at: str = "at", seq: str = "seq", event: str = "event", retries: int = 3, back_off: tuple[int, ...] = BACK_OFF, late: str | None = None,
) -> DataFrame:
    """A stream of states: a row for each request whose events a micro-batch holds or whose time to wait is over.

    Columns: the key, ``state``, ``retries``, ``wait_s`` (seconds to wait after the last failure), ``ready`` (pending, and not
    waiting), ``n_events``, and ``version``, which grows with each row of a request. After the first, second and third failure
    a request waits the seconds of ``back_off``, then a timer fires and it is ready again; a start before that ends the wait.
    Timers go by the clock, or with ``late`` by event time under a watermark that is so far behind. Events with null keys,
    times or kinds are left out.
    """
    ship(events.sparkSession)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a worker beside the driver sets the processor up and has no files of ours
    rows = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(event).isNotNull())
    rows = rows.select(F.col(key), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("seq"), F.col(event).alias("event"))
    if late:
        rows = rows.withWatermark("at", late)
    field = rows.schema[key]
    out = StructType([StructField(key, field.dataType), StructField("state", StringType()), StructField("retries", IntegerType()), StructField("wait_s", IntegerType()), StructField("ready", BooleanType()), StructField("n_events", LongType()), StructField("version", LongType())])
    return rows.groupBy(key).transformWithState(QueueProcessor(field, retries, back_off, bool(late)), out, "update", "EventTime" if late else "ProcessingTime")


def start_queue(states: DataFrame, target: str, checkpoint: str, every: str | None = None, by_clock: bool = True) -> StreamingQuery:
    """Write a stream of :func:`queue_states` as one partition of ``target`` for each micro-batch: what is there now, or ``every`` so often (``"5 seconds"``).

    State is kept in RocksDB below ``checkpoint``. Timers by the clock need ``every``: a run over what is there now ends with
    its data, and leaves them to the next. One with timers by event time (not ``by_clock``) goes on until the watermark has
    fired them. The session's own settings stay for other streams.
    """
    spark = states.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    wanted = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(bool(every) or not by_clock).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        writer = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def read_queue(spark: SparkSession, target: str, key: str = "key") -> DataFrame:
    """The last state of each request."""
    return latest(spark.read.parquet(target), [key], ["version"]).drop("batch", "version")
