"""The decision log as mergeable states of its runs: a run is folded once, and answers over all runs merge states and never read old logs.

log: run_id, doc_id, decision, minutes, the entity and flag columns, one row an occurrence (see :mod:`korpusmill.operators.decisions`).

``path/<table>/v=<n>`` holds what version n wrote; ``path/manifests/<n>`` lists each run with the version that holds its state. The
pointer ``path/CURRENT`` is renamed into place last, so a write that breaks off changes nothing that readers see.

Distinct documents do not add up over runs, so their sets are kept. Every document has a number for good: a hash bucket and its
place in that bucket. A set is cut into pages of 32,768 numbers; a page with few documents is a short list, one with many a
bitmap. Bitmaps are merged by OR; listed documents count where the merged bitmap of their page lacks them. The counts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpusmill.functions.checkpoints import cut
from korpusmill.functions.sizes import small
from korpusmill.operators.decisions import aggregate_log
from korpusmill.sources.tables import _point

#: The longest list of a page; a bitmap has 4,096 bytes.
FEW = 512
#: Numbers of one hash bucket of documents.
SPAN = 1 << 40


@dataclass
class RunStates:
    """``by`` is the entity column, ``buckets`` how many hash buckets number the documents (a task numbers the new ones of a bucket)."""

    spark: SparkSession
    path: str
    by: str = "entity"
    flags: list[str] = field(default_factory=list)
    buckets: int = 64
    version: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RunStates:
        version = int(spark.read.text(f"{path}/CURRENT").first().value)
        head = spark.read.parquet(f"{path}/settings").first()
        return cls(spark, path, head.by, list(head.flags), head.buckets, version)

    def put(self, log: DataFrame) -> RunStates:
        """The runs of ``log``, each with all its rows; a run that is there already is replaced. Logs of other runs are not needed.

        Null runs, entities and documents: a null run or entity is one of its own, a null document counts nowhere. Repeated rows
        count each. An empty log changes nothing.
        """
        after = self.version + 1
        log = cut(log.select("run_id", self.by, "doc_id", "decision", F.col("minutes").cast("double").alias("minutes"), *self.flags))
        if log.isEmpty():
            return self
        self._number(log, after)
        numbers = self._table("docs", after).select("doc_id", "number")
        self._write(aggregate_log(log, ["run_id", self.by], self.flags).join(self._more(log), self._same("run_id", self.by), "left").drop("_run", "_by"), "entities", after)
        self._write(self._counts(log), "kinds", after)
        seen = log.select("run_id", self.by, "doc_id").distinct().join(numbers, "doc_id")
        page = seen.select("run_id", self.by, F.bitmap_bucket_number("number").alias("page"), F.bitmap_bit_position("number").cast("int").alias("pos"))
        page = page.groupBy("run_id", self.by, "page").agg(F.collect_list("pos").alias("few"), F.bitmap_construct_agg("pos").alias("bits"))
        many = F.size("few") > FEW
        self._write(page.select("run_id", self.by, "page", F.when(~many, F.col("few")).alias("few"), F.when(many, F.col("bits")).alias("bits")), "pages", after)
        new = log.select("run_id").distinct().withColumn("v", F.lit(after))
        return self._commit(self._without(new.select(F.col("run_id").alias("_run"))).unionByName(new), after)

    def drop(self, runs: DataFrame) -> RunStates:
        """Without the runs of ``runs`` (run_id)."""
        return self._commit(self._without(runs.select(F.col("run_id").alias("_run")).distinct()), self.version + 1)

    def runs(self) -> DataFrame:
        """(run_id, v): each run and the version that wrote it."""
        if self.version == 0:
            return self.spark.createDataFrame([], "run_id string, v int")
        return self.spark.read.parquet(f"{self.path}/manifests/{self.version}")

    def entities_by_run(self) -> DataFrame:
        """Equal to ``aggregate_log(log, ["run_id", by], flags)``."""
        return self._live("entities").drop("v", "max_minutes", "some_minutes")

    def entities(self) -> DataFrame:
        """Equal to ``aggregate_log(log, [by], flags)`` over the logs of all runs."""
        return self._merged().select(self.by, "n", "n_docs", "minutes", "decisions", *self.flags)

    def recurrence_facts(self, flag: str) -> DataFrame:
        """Equal to :func:`korpusmill.operators.decisions.recurrence_facts` over the logs of all runs, for one of the flags."""
        return self._merged().select(self.by, "n_docs", "max_minutes", F.round("some_minutes", 2).alias("minutes"), F.col(flag).alias("flagged"))

    def run_stats(self, kinds: list[str]) -> DataFrame:
        """Equal to ``run_stats(log, ["run_id"], kinds)``."""
        return self._live("kinds").select("run_id", "n", "n_docs", *[F.coalesce(F.try_element_at("kinds", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in kinds])

    def _merged(self) -> DataFrame:
        state = self._live("entities")
        parts = [F.col(c) for c in ("n", "minutes", "max_minutes", "some_minutes", "decisions", *self.flags)]
        none = {"n": F.lit(0).cast("long"), "minutes": F.lit(0.0), "decisions": F.array().cast("array<string>")}
        docs = self._documents().select(self.by, F.col("n").alias("n_docs"), *[none.get(c, F.lit(None)).cast(state.schema[c].dataType).alias(c) for c in ("n", "minutes", "max_minutes", "some_minutes", "decisions", *self.flags)])
        both = state.select(self.by, F.lit(0).cast("long").alias("n_docs"), *parts).unionByName(docs)
        return both.groupBy(self.by).agg(
            F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.round(F.sum("minutes"), 2).alias("minutes"), F.max("max_minutes").alias("max_minutes"), F.sum("some_minutes").alias("some_minutes"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("decisions")))).alias("decisions"), *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in self.flags],
        )

    def _documents(self) -> DataFrame:
        """(by, n) to be summed: the bits of merged bitmaps, and listed documents that those lack."""
        pages = self._live("pages")
        bits = pages.filter("bits is not null").groupBy(self.by, "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        few = pages.filter("few is not null").select(self.by, "page", F.explode("few").alias("pos")).distinct()
        other = bits.select(F.col(self.by).alias("_by"), F.col("page").alias("_page"), "bits")
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        there = F.coalesce(F.getbit(byte, F.col("pos") % 8) == 1, F.lit(False))
        lone = few.join(other, F.col(self.by).eqNullSafe(F.col("_by")) & (F.col("page") == F.col("_page")), "left").filter(~there).groupBy(self.by).agg(F.count("*").alias("n"))
        return bits.select(self.by, F.bitmap_count("bits").alias("n")).unionByName(lone)

    def _more(self, log: DataFrame) -> DataFrame:
        """What other answers need of an entity: the most minutes, and their sum where there are any."""
        return log.groupBy(F.col("run_id").alias("_run"), F.col(self.by).alias("_by")).agg(F.max("minutes").alias("max_minutes"), F.sum("minutes").alias("some_minutes"))

    def _counts(self, log: DataFrame) -> DataFrame:
        """Per run: rows, documents and rows of each decision."""
        kind = F.coalesce("decision", F.lit("discard"))
        kinds = log.groupBy(F.col("run_id").alias("_run"), kind.alias("kind")).agg(F.count("*").alias("k"))
        kinds = kinds.groupBy("_run").agg(F.map_from_entries(F.collect_list(F.struct("kind", "k"))).alias("kinds"))
        whole = log.groupBy("run_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
        return whole.join(kinds, self._same("run_id"), "left").drop("_run")

    def _same(self, run: str, by: str | None = None) -> Column:
        out = F.col(run).eqNullSafe(F.col("_run"))
        return out if by is None else out & F.col(by).eqNullSafe(F.col("_by"))

    def _number(self, log: DataFrame, after: int) -> None:
        """Numbers for documents that have none yet, those after the last of their bucket."""
        old = self._table("docs", self.version) if self.version else self.spark.createDataFrame([], f"doc_id {log.schema['doc_id'].dataType.simpleString()}, bucket int, number long")
        new = log.select("doc_id").filter("doc_id is not null").distinct().join(old.select("doc_id"), "doc_id", "left_anti")
        last = F.broadcast(old.groupBy("bucket").agg((F.max("number") - F.col("bucket") * F.lit(SPAN)).alias("last")))  # a row a bucket
        new = new.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")).join(last, "bucket", "left")
        place = F.row_number().over(W.partitionBy("bucket").orderBy("doc_id")) + F.coalesce("last", F.lit(0))
        self._write(new.select("doc_id", "bucket", (F.col("bucket") * F.lit(SPAN) + place).alias("number")), "docs", after)

    def _write(self, df: DataFrame, name: str, v: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/v={v}")

    def _table(self, name: str, upto: int) -> DataFrame:
        """All that committed versions, and the one being written, hold of a table."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}").filter(F.col("v") <= upto)

    def _live(self, name: str) -> DataFrame:
        """The rows of runs as the manifest has them; folders of other versions are pruned."""
        manifest = small(self.runs().select(F.col("run_id").alias("_run"), F.col("v").alias("_v")))
        return self._table(name, self.version).join(manifest, self._same("run_id") & (F.col("v") == F.col("_v"))).drop("_run", "_v")

    def _without(self, runs: DataFrame) -> DataFrame:
        return self.runs().join(runs, self._same("run_id"), "left_anti")

    def _commit(self, manifest: DataFrame, after: int) -> RunStates:
        if self.version == 0:
            self.spark.createDataFrame([(self.by, self.flags, self.buckets)], "by string, flags array<string>, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{after}")
        _point(self.spark, self.path, str(after))
        return replace(self, version=after)
