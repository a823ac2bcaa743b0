"""A keyed table in hash buckets with a manifest: an upsert rewrites the buckets that it touches, and readers see all of it or none.

``path/v=<n>/bucket=<b>`` holds the rows of bucket b that version n wrote; ``path/manifests/<n>`` lists for every bucket the version
that holds it, with the number of its rows. The pointer ``path/CURRENT`` is renamed into place last. A write that breaks off leaves
the pointer, and all files that it leads to, as they were.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from korpusmill.functions.checkpoints import cut
from korpusmill.sources.tables import _point, latest


@dataclass
class BucketedTable:
    """``versions`` maps each bucket that has rows to the version that holds them."""

    spark: SparkSession
    path: str
    keys: list[str]
    n: int
    schema: StructType
    version: int
    versions: dict[int, int]

    @classmethod
    def create(cls, df: DataFrame, path: str, keys: list[str], n: int = 64) -> BucketedTable:
        """The rows of ``df``, one for each key (the greatest by all columns), in ``n`` buckets by a hash of the key."""
        table = cls(df.sparkSession, path, keys, n, df.schema, 0, {})
        return table._commit(latest(df, keys), set(range(n)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketedTable:
        version = int(spark.read.text(f"{path}/CURRENT").first().value)
        rows = spark.read.parquet(f"{path}/manifests/{version}").collect()  # a row for each bucket
        head = next(r for r in rows if r.bucket == -1)
        keys, n, schema = head.note.split("\n", 2)
        return cls(spark, path, keys.split(","), int(n), StructType.fromJson(json.loads(schema)), version, {r.bucket: r.version for r in rows if r.bucket >= 0})

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n)).cast("int")

    def read(self, buckets: set[int] | None = None) -> DataFrame:
        """The rows of the version that was opened, of all buckets or of some; only their folders are listed and read."""
        wanted = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(self.versions.items()) if buckets is None or b in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*wanted)

    def upsert(self, new: DataFrame, order: list[str] = []) -> BucketedTable:  # noqa: B006
        """``new`` over the table, by the rules of :func:`korpusmill.sources.tables.upsert`; buckets without a new key are neither read nor written."""
        new = cut(new.select(*self.schema.names))
        touched = {r.b for r in new.select(self.bucket().alias("b")).distinct().collect()}  # n numbers at most
        if not touched:
            return self
        old = self.read(touched)
        if order:
            return self._commit(latest(old.unionByName(new), self.keys, order), touched)
        last = latest(new, self.keys)
        return self._commit(old.join(last.select(*self.keys), self.keys, "left_anti").select(*self.schema.names).unionByName(last), touched)

    def replace_where(self, new: DataFrame, condition: Column, by_key: bool = True) -> BucketedTable:
        """Rows that meet the condition go, then ``new`` comes in by key. Only buckets that hold such rows or new keys are written.

        Without ``by_key`` all rows of ``new`` are added beside those that stay, as :func:`korpusmill.sources.tables.replace_where`
        does, equal keys or not; a later upsert of such a key leaves one row of it.
        """
        new = new.select(*self.schema.names)
        new = cut(latest(new, self.keys) if by_key else new)
        hit = self.read().filter(F.coalesce(condition, F.lit(False))).select(self.bucket().alias("b"))
        touched = {r.b for r in hit.unionByName(new.select(self.bucket().alias("b"))).distinct().collect()}
        if not touched:
            return self
        kept = self.read(touched).filter(~F.coalesce(condition, F.lit(False)))
        if by_key:
            kept = kept.join(new.select(*self.keys), self.keys, "left_anti").select(*self.schema.names)
        return self._commit(kept.unionByName(new), touched)

    def _commit(self, rows: DataFrame, touched: set[int]) -> BucketedTable:
        """Write the touched buckets, then their manifest, then the pointer."""
        after = self.version + 1
        folder = f"{self.path}/v={after}"
        rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self._buckets(folder)
        versions = {b: v for b, v in self.versions.items() if b not in touched} | dict.fromkeys(written, after)
        note = "\n".join([",".join(self.keys), str(self.n), self.schema.json()])
        listed = [(-1, after, note), *((b, v, "") for b, v in sorted(versions.items()))]
        self.spark.createDataFrame(listed, "bucket int, version int, note string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{after}")
        _point(self.spark, self.path, str(after))
        return BucketedTable(self.spark, self.path, self.keys, self.n, self.schema, after, versions)

    def _buckets(self, folder: str) -> list[int]:
        """The buckets that have a folder, by the file system that Spark uses."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = [s.getPath().getName() for s in place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
        return sorted(int(x.split("=")[1]) for x in names if x.startswith("bucket="))
