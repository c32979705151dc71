"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from grove.plans.registry import QUERIES, SQL

DATA = os.environ.get("GROVE_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(SQL[name]).df())
