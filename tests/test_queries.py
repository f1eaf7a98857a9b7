"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from check import connect, rows_of
from cohortwave.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LEARNED = [n for n in QUERIES if n not in ORACLES]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got_names, got = rows_of(df.columns, df.collect())
    cur = duck.execute(ORACLES[name])
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_names == want_names
    assert got == want


def test_every_query_without_sql_is_known():
    assert all(n in QUERIES for n in ORACLES)
    assert set(LEARNED) <= {n for n in QUERIES if n.startswith(("m", "a23", "a27", "f4", "e12", "s11", "flow"))}


def test_entry(spark):
    assert entry(spark).count() > 0
