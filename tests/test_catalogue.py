"""Every registered query of the engine beside its SQL on the smallest tables."""

import math

import duckdb
import pytest

from siltstone.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    found = QUERIES[name](spark, SF)
    want = sql.sql(ORACLES[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    got = key([tuple(r[n] for n in names) for r in found.collect()])
    at = [want.columns.index(n) for n in names]
    expected = key([tuple(r[i] for i in at) for r in want.fetchall()])
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
