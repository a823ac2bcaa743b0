"""One row of each class of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import cut, fresh


def checked(df: DataFrame, most: int) -> DataFrame:
    """A narrow table, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_keepers(rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` (``id``, ``th``, ``copies``, ``component``) with the ``keeper`` (``id``, ``th``) of the component and its ``size`` in copies.

    The keeper has the smallest id, null being the largest, and of several that share it the smallest text hash.
    """
    rows = cut(rows)
    here = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    keepers = cut(rows.groupBy("component").agg(F.min(here).alias("_keeper"), F.sum("copies").alias("_size")).filter("_size > 1"))
    out = rows.join(checked(keepers, broadcast_rows), "component", "left")
    return out.select("component", "id", "th", "copies", F.coalesce("_keeper", here).alias("keeper"), F.coalesce("_size", F.lit(1)).alias("size"))


def keep_keepers(docs: DataFrame, classes: DataFrame, broadcast_rows: int, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are keepers of ``classes`` (:func:`with_keepers`, by ``doc_id`` and xxhash64 of ``text``), once each.

    What goes is taken out by an anti join, broadcast if it has at most ``broadcast_rows`` rows, so that texts need not move.
    """
    own, of = fresh(docs, "own"), fresh(docs, "text_hash")
    classes = cut(classes.filter("size > 1"))
    chosen = F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("th") == F.col("keeper.th"))
    named = lambda df: df.select(F.col("id").alias(own), F.col("th").alias(of))
    gone, again = named(classes.filter(~chosen | (F.col("copies") > 1))), named(classes.filter(chosen & (F.col("copies") > 1)))
    here = F.col(doc_id).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(text)) == F.col(of))
    repeated = docs.join(checked(again, broadcast_rows), here, "left_semi").withColumn(of, F.xxhash64(F.col(text))).dropDuplicates([doc_id, of]).drop(of)
    return docs.join(checked(gone, broadcast_rows), here, "left_anti").unionByName(repeated)
