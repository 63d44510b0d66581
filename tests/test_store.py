"""Jobs give the same results on stored tables as on the fixture mapping."""

from pyspark.sql import functions as F

from stewardlake.operators import access as A
from stewardlake.operators import catalog as C
from stewardlake.operators import metadata as M
from stewardlake.plans.params import requests_as_of
from stewardlake.sources.fixtures import tables
from stewardlake.sources.store import StoredTables, store_marketplace

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_jobs_on_stored_tables(spark, tmp_path):
    t = tables(spark, SF)
    store_marketplace(t, str(tmp_path / "store"))
    s = StoredTables(spark, SF, str(tmp_path / "store"))
    as_of = requests_as_of()
    assert same(A.access_state(t.access_requests, t.users, as_of), A.access_state(s.access_requests, s.users, as_of))
    assert same(A.notifications(t.access_requests, t.data_products, as_of),
                A.notifications(s.access_requests, s.data_products, as_of))
    assert same(C.facets(C.normalize_products(C.catalog_published(t.data_products))),
                C.facets(C.normalize_products(C.catalog_published(s.data_products))))
    assert same(M.sync_metadata(t.data_products, t.meta_tables, as_of), M.sync_metadata(s.data_products, s.meta_tables, as_of))
    q1 = s.fact_months("access_requests", "1998-01", "1998-03")
    assert "PartitionFilters: [isnotnull(ym" in q1._jdf.queryExecution().executedPlan().toString()
    want = t.access_requests.filter(F.date_format("requested_at", "yyyy-MM").between("1998-01", "1998-03"))
    assert same(q1, want)
