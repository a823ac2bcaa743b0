"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``edges`` (``src``, ``dst``: longs).

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the number of nodes and the
    table never grows; each round is cut by a checkpoint. Loops and repeated edges do no harm.
    """
    now = cut(_oriented(edges))
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark.n:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        now = _oriented(large)
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = now.join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        now = cut(_oriented(small.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))))
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges u > v."""
    return edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
