"""Settings that right results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def plain_unions(spark: SparkSession) -> None:
    """No partitioning is claimed for unions.

    Spark 4.1 takes a union for partitioned by a key if its sides are, and leaves out the exchange above it; where adaptive
    execution has coalesced the sides differently, groups then come out in several rows (seen with two ranked lanes that were
    grouped by query). Costs an exchange where the claim would have been right.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
