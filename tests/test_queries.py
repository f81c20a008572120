"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    cols = sorted(df.columns)
    return pd.DataFrame({c: df[c].map(text) for c in cols}).sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(rows(got), rows(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
