"""Every registered query of the statistics part runs; those with SQL give DuckDB's rows."""

import glob
import math
import os

import pytest

from statloom import registry

duckdb = pytest.importorskip("duckdb")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def _same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(x) and math.isnan(y))
    return x == y


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    key = lambda r: [(v is None, str(v)) for v in r]
    mine = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=key)
    assert len(mine) == len(theirs)
    assert all(_same(x, y) for a, b in zip(mine, theirs, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", ["anderson_darling", "bootstrap_mean", "cross_validate_linear", "fisher_exact", "gaussian_mixture", "glm_poisson", "principal_components", "shapiro_wilk"])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
