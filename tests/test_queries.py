"""Each registered query of this part against its SQL in DuckDB."""
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from feedloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows_of(frame):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
            return "~"
        if isinstance(v, (float, np.floating)) or hasattr(v, "as_tuple"):
            return round(float(v), 6)
        return v

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["category", "position", "id", "source_title", "reason", "final"]
    assert set(registry.ORACLE_SQL) <= set(entry.queries())


def test_halves_of_limits(spark, tmp_path):
    """Prices on a half, which SQL rounds to the even number."""
    made = [(n, n % 5 * 0.01 + 50_500.0 + 1000.0 * n) for n in range(1, 120)] + [(n, 50_500.0 + 1000.0 * (n % 100)) for n in range(120, 330)] + [(400, None)]
    path = str(tmp_path)
    spark.createDataFrame(made, "o_orderkey long, o_totalprice double").coalesce(1).write.parquet(f"{path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS FROM read_parquet('{path}/orders.parquet/*.parquet')")
    assert rows_of(registry.QUERIES["clamp_limit"](spark, path).toPandas()) == rows_of(con.sql(registry.ORACLE_SQL["clamp_limit"]).df())
