"""Every registered query of the library against its SQL, on a small folder."""

import glob
import math

import duckdb
import pytest

from qiyas.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {f.split('/')[-1][:-8]} as from '{f}'")
    return con


def cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(map(cell, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=key)
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (columns, len(bad), bad[:3])
