"""Every registered catalog query against its DuckDB oracle (order-insensitive)."""

import pytest

import __spark_entry__ as E
from stewardlake.plans import registry
from tools.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF)
    a = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[key])
    b = canon([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0], f"columns differ: {a[0]} vs {b[0]}"
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["requester_id", "product_id", "product_ref", "display_name", "type", "domain", "state",
                          "request_id", "can_query"]
    assert df.count() > 0
