"""Snapshots in key ranges with digests: what two snapshots have alike is not read to compare them.

``path/rows/range=<r>`` holds the rows of a key range with a hash of each; ``path/leaves/node=<d>`` a digest for each range, and
``path/nodes`` one for each ``WIDTH`` ranges. A snapshot is written with the bounds of the one before, so that ranges can be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.functions.checkpoints import cut

#: Ranges below one node of the tree.
WIDTH = 16
#: A digest has four numbers of 60 bits of a SHA-256.
PARTS = (1, 16, 31, 46)


@dataclass
class RangeSnapshot:
    spark: SparkSession
    path: str
    key: str

    @classmethod
    def write(cls, df: DataFrame, path: str, key: str, body: str, ranges: int = 256, like: RangeSnapshot | None = None) -> RangeSnapshot:
        """``df`` (key, body) as a snapshot: with the bounds of ``like``, else with at most ``ranges`` ranges of about equal numbers of keys.

        Rows without a key are left out; a null body differs from an empty one; an empty table is a snapshot without ranges. Texts of
        any length are hashed whole. Other columns are not kept. ``path`` is not that of ``like``.
        """
        spark = df.sparkSession
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(body).alias("body"))
        if like is None:
            by_part = rows.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("bound"))
            bounds = by_part.select("bound").distinct().coalesce(1)
        else:
            bounds = spark.read.parquet(f"{like.path}/bounds").coalesce(1)
        bounds.write.mode("overwrite").parquet(f"{path}/bounds")
        table = F.broadcast(spark.read.parquet(f"{path}/bounds").agg(F.array_sort(F.collect_list("bound")).alias("b")))  # one row of at most `ranges` keys
        h = F.sha2(F.concat_ws(":", F.sha2(F.col("key").cast("string"), 256), F.coalesce(F.sha2(F.col("body"), 256), F.lit("null"))), 256)
        rows = rows.crossJoin(table.select(_firsts(F.col("b")).alias("firsts"), "b")).select("key", "body", h.alias("h"), _range(F.col("key"), F.col("firsts"), F.col("b")).alias("range"))
        rows.repartition("range").sortWithinPartitions("range", "key").write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
        digest = [F.bit_xor(F.conv(F.substring("h", p, 15), 16, 10).cast("long")).alias(f"d{p}") for p in PARTS]
        kept = spark.read.schema("h string, `range` int").parquet(f"{path}/rows")
        leaves = cut(kept.groupBy("range").agg(F.count("*").alias("n"), *digest).withColumn("node", F.floor(F.col("range") / WIDTH).cast("int")))
        leaves.coalesce(1).write.mode("overwrite").partitionBy("node").parquet(f"{path}/leaves")
        leaves.groupBy("node").agg(F.sum("n").alias("n"), *[F.bit_xor(f"d{p}").alias(f"d{p}") for p in PARTS]).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(key, df.schema[key].dataType.simpleString())], "key string, type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        return cls(spark, path, key)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RangeSnapshot:
        return cls(spark, path, spark.read.parquet(f"{path}/settings").first().key)

    def rows(self, hashes: bool = True) -> DataFrame:
        """(key, range), with the hash of each row on demand; bodies are not read."""
        kind = self.spark.read.parquet(f"{self.path}/settings").first().type
        return self.spark.read.schema(f"key {kind}, {'h string, ' if hashes else ''}`range` int").parquet(f"{self.path}/rows")


def _firsts(bounds: Column) -> Column:
    """Each ``WIDTH``-th bound."""
    return F.filter(bounds, lambda x, i: i % WIDTH == 0)


def _range(key: Column, firsts: Column, bounds: Column) -> Column:
    """The number of the last bound that is not greater, by two short scans; keys below all bounds are in the first range."""
    node = F.greatest(F.size(F.filter(firsts, lambda b: b <= key)) - 1, F.lit(0))
    below = F.size(F.filter(F.slice(bounds, node * WIDTH + 1, F.lit(WIDTH)), lambda b: b <= key))
    return F.greatest(node * WIDTH + below - 1, F.lit(0))


def _differing(a: DataFrame, b: DataFrame, key: str) -> list[int]:
    """Numbers of nodes or ranges that are not alike on both sides."""
    alike = F.lit(True)
    for c in ("n", *(f"d{p}" for p in PARTS)):
        alike = alike & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return sorted(r.k for r in both.filter(~alike).select(F.coalesce(f"a.{key}", f"b.{key}").alias("k")).collect())


def changed_ranges(before: RangeSnapshot, after: RangeSnapshot) -> list[int]:
    """Ranges whose rows differ; only nodes that differ have their ranges looked at. At most as many numbers as there are ranges."""
    spark = before.spark
    nodes = _differing(*(spark.read.parquet(f"{s.path}/nodes") for s in (before, after)), "node")
    if not nodes:
        return []
    shape = "`range` int, n long, " + ", ".join(f"d{p} long" for p in PARTS) + ", node int"
    return _differing(*(spark.read.schema(shape).parquet(f"{s.path}/leaves").filter(F.col("node").isin(nodes)) for s in (before, after)), "range")


def changes(before: RangeSnapshot, after: RangeSnapshot, unchanged: bool = False) -> DataFrame:
    """(key, status): new, changed or gone; with ``unchanged`` also all other keys, as :func:`korpusmill.operators.patches.change_report` has them.

    Only the folders of ranges that differ are read, and of those keys and hashes; of the others keys alone, if they are asked for.
    A key that stands twice in a snapshot meets every row of it in the other one.
    """
    hit = changed_ranges(before, after)
    a = before.rows().filter(F.col("range").isin(hit)).select(F.col("key").alias("_a"), F.col("h").alias("ha"), F.col("range").alias("ra"))
    b = after.rows().filter(F.col("range").isin(hit)).select(F.col("key").alias("_b"), F.col("h").alias("hb"), F.col("range").alias("rb"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("ha") == F.col("hb"), "unchanged").otherwise("changed")
    out = a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(after.key), status.alias("status"))
    if not unchanged:
        return out.filter("status <> 'unchanged'")
    same = after.rows(hashes=False).filter(~F.col("range").isin(hit)).select(F.col("key").alias(after.key), F.lit("unchanged").alias("status"))
    return out.unionByName(same)
