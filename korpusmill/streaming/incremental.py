"""Incremental runs: what is new, streams of documents and events, and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.sources.tables import latest


def _timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """``df`` with a watermark; event time is a timestamp of the session's zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def pending(docs: DataFrame, ledger: DataFrame, key: str = "doc_id", everything: bool = False, limit: int | None = None) -> DataFrame:
    """Documents that the ledger does not hold, all of them on demand; the first ``limit`` by key if given."""
    out = docs if everything else docs.join(ledger.select(key).distinct(), key, "left_anti")
    return out if limit is None else out.orderBy(key).limit(limit)


def first_last(runs: DataFrame, key: str, run: str) -> DataFrame:
    return runs.groupBy(key).agg(F.min(run).alias("first_run"), F.max(run).alias("last_run"), F.count("*").alias("n_runs"))


def event_rates(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str | None = None, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums per window and kind; with ``late``, rows later than that behind the newest are left out of a stream."""
    src = _timed(events, ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = src.groupBy(w, kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts", late: str | None = None) -> DataFrame:
    src = _timed(events, ts, late) if late else events
    out = src.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("s.start").alias("start"), "n")


def run_stream(
    spark: SparkSession, source: str, schema, transform, target: str, checkpoint: str, keys: list[str], most_files: int = 20, order: list[str] = [], before_batch=None,  # noqa: B006
) -> None:
    """Process what is new below ``source`` and stop. Micro-batches of ``most_files`` go through ``transform`` and into ``target``.

    The checkpoint remembers what was read. A batch is reduced to the last row of each key by ``order`` and written as one
    partition ``batch=<number>``; nothing that is there is read or written again, so the work of a batch is that of its own
    rows. A batch that runs again after a failure replaces its own partition. Read the table by :func:`read_stream`, and
    fold old batches now and then by :func:`compact`.

    ``before_batch`` (spark -> anything) is called for each batch and its result is passed to ``transform`` after the batch,
    so that a batch sees what the batches before it have written, such as pages that they created.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = transform(batch) if before_batch is None else transform(batch, before_batch(batch.sparkSession))
        latest(new, keys, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, target: str, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """The table that :func:`run_stream` keeps: the last row of each key by ``order``, and of equals that of the last batch."""
    return latest(spark.read.parquet(target), keys, [*order, "batch"]).drop("batch")


def compact(spark: SparkSession, target: str, into: str, keys: list[str], order: list[str] = []) -> None:  # noqa: B006
    """The batches of ``target`` folded into one of the last number, in a new folder, where the stream can go on."""
    whole = spark.read.parquet(target)
    last = whole.agg(F.max("batch").alias("b")).first().b
    latest(whole, keys, [*order, "batch"]).drop("batch").write.mode("overwrite").parquet(f"{into}/batch={last}")


def stream_rates(rates: DataFrame, target: str, checkpoint: str) -> int:
    """Write a streamed :func:`event_rates`, as far as events go now, and return how many rows came too late to count.

    Each micro-batch writes the windows that it changed as one partition of ``target``; nothing is held by the driver, and
    state is dropped once the watermark has passed a window. Rows behind it are left out and counted, by the progress reports
    that the session keeps (``spark.sql.streaming.numRecentProgressUpdates``). Read the table by :func:`read_rates`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run = rates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


def read_rates(spark: SparkSession, target: str, kind: str = "event_type") -> DataFrame:
    """The windows of :func:`stream_rates`, each as its last batch left it."""
    return latest(spark.read.parquet(target), ["start", kind], ["batch"]).drop("batch")


def stream_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there and return its result, which is held by the driver: windowed counts and the like, for reports and tests."""
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def dedupe_open(requests: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first request of equal keys in a stream, remembered as long as ``late``."""
    return _timed(requests, ts, late).dropDuplicatesWithinWatermark(keys)


def apply_once(new: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """Decisions whose key is not applied yet; of equal keys the first by all columns."""
    w = W.partitionBy(key).orderBy(*[c for c in new.columns if c != key] or [key])
    return new.join(applied.select(key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
