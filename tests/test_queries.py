"""Every registered query with SQL against DuckDB on the same tables; the others run."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from korpusmill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return None if x is None or x is pd.NaT else str(x) if isinstance(x, pd.Timestamp) else x


def rows(df):
    return sorted((tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, db):
    got = plans.QUERIES[name](spark, sf_dir).toPandas()
    if name in plans.SQL:
        want = db.sql(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_contract(spark):
    assert set(plans.SQL) <= set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
