"""A training corpus from ``documents``: score, deduplicate, decontaminate, mix and shard.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a table; all but the last return
the columns of ``documents``. ``run`` chains them with a checkpoint between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korpusmill.llm import decontamination, mixing, near_dup, quality_classifier, sharding
from korpusmill.llm.common import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a similarity of 0.8 or more of their five-word shingles."""
    return near_dup.keep_one(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by a Poisson count, so that a source weighs the square root of its bytes; in random order."""
    return mixing.mix(docs).drop("copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes, with a slot for each row."""
    return sharding.shard(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The stages hash with XXH64 and fit a network, which DuckDB's SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that the first three stages keep, as often as the fourth says, with ``shard`` and ``slot``.

    Null and empty texts are scored like any other; texts without a word are near-duplicates of each other, as repeated rows are, so
    one row of them stays. Null ids and sources are values of their own. Texts of any length are read whole. An empty table gives an
    empty result. Further columns are kept, but for ``copy`` (stage four uses the name and takes it off again,
    so a column of that name is lost) and ``shard`` and ``slot``, which the last stage replaces.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
