"""The key queries keep keys of up to 20 reference entities, the reference's cap."""

import duckdb
import pytest

from grove.operators import blocking
from grove.plans import queries

NAMES = ["key_candidates", "pair_features", "diff_features", "generic_features", "legal_features", "raw_features", "vocab_counts", "group_gains", "key_sizes"]


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """A part table: keys that 20 reference entities share with 4 records, and keys that 21 share with 4."""
    rows = []
    for k, (name, size, n) in enumerate((("almond rose mill", 7, 20), ("black tea house", 40, 21))):
        rows += [(300 * (k + 1) + 3 * i, name, "STANDARD TIN", size) for i in range(n)] + [(300 * (k + 1) + 3 * i + 1, name, "STANDARD TIN", size) for i in range(4)]
    d = str(tmp_path_factory.mktemp("cap"))
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").coalesce(1).write.parquet(f"file://{d}/part.parquet")
    return d


def test_cap_of_the_queries(spark, shared):
    got = queries.key_candidates(spark, shared).collect()
    assert len(got) == 20 * 4 and {int(r["s1"][3:]) < 600 for r in got} == {True}


def test_small_cap(spark, shared):
    sides = queries.sides(spark, shared)
    assert blocking.key_candidates(*sides, cap=19).count() == 0 and blocking.key_candidates(*sides, cap=21).count() == 20 * 4 + 21 * 4


@pytest.mark.parametrize("name", [n for n in NAMES if n in queries.SQL])
def test_rows_at_the_cap(spark, shared, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{shared}/part.parquet/*.parquet'")
    rows = lambda f: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    got = rows(queries.QUERIES[name](spark, shared).toPandas())
    assert got and got == rows(con.sql(queries.SQL[name]).df())
