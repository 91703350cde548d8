"""Every registered query of the library against its SQL on the smallest tables."""

import math

import pytest

duckdb = pytest.importorskip("duckdb")
from semlake import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        f = float(v)
        return str(int(f)) if f == math.floor(f) else repr(round(f, 6))
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(cell(v) for v in r) for r in df[names].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLES:
        assert got.count() >= 0
        return
    want = con.sql(registry.ORACLES[name]).df()
    assert rows(got.toPandas()) == rows(want)
