"""Results that are used again, kept where executors that are lost do no harm."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from korpusmill.functions.session import plain_unions


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a temporary one for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if folder is None and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-shared-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    plain_unions(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
