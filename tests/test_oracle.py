"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from palisade.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            a, b = got[c].astype(float), want[c].astype(float)
            assert (((a - b).abs() <= 1e-6) | (a == b) | (a.isna() & b.isna())).all(), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c
