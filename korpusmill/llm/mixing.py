"""Mixing sources to target weights by Poisson replication, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.common import cut, fresh, text_size

#: Means above this are split into equal independent parts, so that exp(-mean) stays exact.
LARGEST_MEAN = 32


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1), the same on every run and machine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, epochs: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """Per source: ``bytes``, ``rate`` (mean copies of each of its documents), ``parts`` and ``cdf`` of one part.

    weights: source, weight. A source that is missing there gets weight 0. Without weights, a source weighs its bytes to the
    ``power``, which evens out large and small sources. Rates are such that the expected bytes of all copies are ``epochs``
    times the bytes of all documents, shared out by weight.
    """
    size = cut(docs.groupBy(F.col(source).alias("source")).agg(F.sum(text_size(F.col(text)) + 1).alias("bytes")))  # texts are read once
    if weights is None:
        size = size.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(power)))
    else:
        w = weights.groupBy(F.col("source").alias("of")).agg(F.sum("weight").cast("double").alias("weight"))
        size = size.join(w, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "bytes", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = size.agg(F.sum("bytes").cast("double").alias("bytes"), F.sum("weight").alias("weight")).first()
    share = epochs * (whole.bytes or 0.0) * F.col("weight") / F.lit(whole.weight or 1.0) / F.col("bytes")
    out = size.select("source", "bytes", share.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN), F.lit(1)).cast("int"))
    part = F.col("rate") / F.col("parts")
    last = F.ceil(part + 12 * F.sqrt(part) + 20).cast("int")
    step = lambda acc, k: F.struct((acc["p"] * part / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / k)).alias("cdf"))
    first = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))
    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), first, step)["cdf"])


def mix(
    docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 17, broadcast_sources: int = 100_000,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Each row of ``docs`` as often as a Poisson count says, with ``copy`` (0 upwards), in a global random order.

    The count inverts the Poisson distribution, whose mean is the rate of the row's source, at a number hashed from the
    seed and the id. Rows are then dealt out by a hash of seed, id, copy and text, and sorted by it in each partition; the text is
    in it so that rows that share an id, null say, do not all go to one task.

    A null source is a source of its own; null texts count one byte and texts of any length are hashed whole; rows with the same id (null too) get the same count;
    an empty table gives an empty result; a column of ``docs`` named ``copy`` is replaced.
    """
    docs = docs.drop("copy")
    of, rate, parts, cdf, key = (fresh(docs, x) for x in ("of", "rate", "parts", "cdf", "key"))
    table = rates(docs, weights, power, epochs, source, text).select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    if table.limit(broadcast_sources + 1).count() <= broadcast_sources:
        table = F.broadcast(table)
    count = F.aggregate(
        F.sequence(F.lit(1), F.col(parts)), F.lit(0),
        lambda acc, j: acc + F.size(F.filter(F.col(cdf), lambda x: x <= uniform(seed, F.col(doc_id), j))),
    )
    one = F.size(F.filter(F.col(cdf), lambda x: x <= F.col(rate)))
    out = docs.join(table, F.col(source).eqNullSafe(F.col(of))).withColumn(rate, uniform(seed, F.col(doc_id), F.lit(1)))
    n = F.when(F.col(parts) == 1, one).otherwise(count)
    out = out.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    out = out.withColumn(key, F.xxhash64(F.lit(seed), F.col(doc_id), F.col("copy"), F.col(text)))
    return out.repartition(F.col(key)).sortWithinPartitions(key).select(*docs.columns, "copy")
