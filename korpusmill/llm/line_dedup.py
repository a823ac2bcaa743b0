"""Removal of repeated passages of lines, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import cut, fresh
from korpusmill.llm.keeping import checked


def dedup_lines(docs: DataFrame, window: int = 3, broadcast_rows: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without repeated lines, ``n_lines`` and ``removed`` (sorted numbers of the lines removed, from 0).

    Lines are what "\\n" separates. Each ``window`` consecutive lines are hashed (two 64-bit hashes); where a window occurs more
    than once, in any documents, all but its first occurrence (smallest id, then smallest position) mark the lines they
    cover, and marked lines go. Windows are judged on the input, not on what is left. Texts do not move where at most
    ``broadcast_rows`` documents lose lines.

    A null text has no lines and stays null; an empty text has one empty line; texts of fewer lines than ``window`` stay; rows
    with a null id come first, and rows that share an id are told apart by their text (exact copies of a row with the same
    id count as one occurrence and keep the same lines); an empty table gives an empty result; columns of ``docs`` named
    ``n_lines`` or ``removed`` are replaced.
    """
    docs = docs.drop("n_lines", "removed")
    lines, row, own = (fresh(docs, x) for x in ("lines", "row", "own"))
    split = F.split(F.col(text), "\n", -1)
    #: A row is known by its id and, should ids repeat, a hash of its text.
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("h"), split.alias("lines"))
    hashed = base.select(
        "id", "h", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit("b"), x)).alias("b"),
    )
    at = lambda c, i: F.xxhash64(*[F.get(F.col(c), i + j) for j in range(window)])
    windows = F.when(F.size("a") >= window, F.transform(F.sequence(F.lit(0), F.size("a") - window), lambda i: F.struct(at("a", i).alias("a"), at("b", i).alias("b"))))
    # an outer explode keeps the optimizer from working the windows out once more in a filter below it
    spots = hashed.select("id", "h", F.posexplode_outer(windows).alias("pos", "w")).filter("pos is not null").select("id", "h", "pos", "w.a", "w.b")
    here = F.struct("id", "h", "pos")
    repeated = spots.groupBy("a", "b").agg(F.min(here).alias("first"), F.max(here).alias("last")).filter(F.col("first") != F.col("last")).select("a", "b", "first")
    # a left side with one very common window is split by adaptive skew joins; the right side has one row a window
    later = spots.join(repeated, ["a", "b"]).filter(here != F.col("first")).select("id", "h", "pos")
    covered = later.groupBy("id", "h").agg(F.collect_set("pos").alias("pos")).select(
        F.col("id").alias(row), F.col("h").alias(own),
        F.array_sort(F.array_distinct(F.flatten(F.transform("pos", lambda p: F.sequence(p, p + window - 1))))).alias("removed"),
    )
    covered = checked(cut(covered), broadcast_rows)
    out = docs.join(covered, F.col(doc_id).eqNullSafe(F.col(row)) & (F.xxhash64(F.col(text)) == F.col(own)), "left")
    out = out.withColumn(lines, split).withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    text_out = F.when(F.size("removed") > 0, kept).otherwise(F.col(text))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    return out.select(*[text_out.alias(text) if c == text else F.col(c) for c in docs.columns], n_lines.alias("n_lines"), "removed")
