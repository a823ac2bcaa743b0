"""Arrow batches through Python, with this package at hand on every executor."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from korpusmill.functions.session import plain_unions

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, as ``--py-files`` would."""
    plain_unions(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        away = os.path.realpath(tempfile.mkdtemp(prefix="ship-"))
        shutil.copytree(root, f"{away}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{away}/{root.name}", "zip", f"{away}/src"))
        _shipped.add(sc.applicationId)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` for functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
