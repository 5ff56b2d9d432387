"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

from tabulon.plans import catalog, filed, queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    assert rows
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert rows == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
