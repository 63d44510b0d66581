"""Results must not depend on the session time zone (all as-of arithmetic is on timestamp_ntz)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"
KEYS = ["freshness", "notifications", "access_state", "backfill_last_refreshed", "gen_revenue_summary",
        "audit_daily_counts", "audit_daily_windows", "spend_by_resource", "sync_metadata"]


@pytest.mark.parametrize("key", KEYS)
def test_non_utc_session(spark, key):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = E.queries()[key](spark, SF)
        a = canon(df.columns, [tuple(r) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = duck(SF).execute(E.oracle_sql()[key])
    assert a == canon([d[0] for d in cur.description], cur.fetchall())
