"""Broadcasts of tables whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.functions.session import plain_unions


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; a larger one is joined by a shuffle."""
    plain_unions(df.sparkSession)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
