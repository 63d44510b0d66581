"""Metadata jobs on literal rows: case rules of J5 / J6, sync (M14), refs (W4), rollup."""

import datetime as dt

from pyspark.sql import functions as F

from stewardlake.operators import catalog as C
from stewardlake.operators import metadata as M
from stewardlake.sources.fixtures import ts_ntz

META = "catalog_name string, schema_name string, table_name string, table_type string, product_id long, updated_at timestamp_ntz"
PROD = "product_id long, product_ref string, uc_full_name string, status string, last_refreshed timestamp_ntz"


def _meta(spark):
    t = dt.datetime(2001, 7, 1)
    return spark.createDataFrame([
        ("main", "sales", "Orders", "MANAGED", 1, t), ("main", "sales", "items", "MANAGED", 2, t),
        ("main", "sales", "__dlt_tmp", "MANAGED", 3, t), ("main", "hr", "people", "MANAGED", 4, None)], META)


def _prods(spark):
    return spark.createDataFrame([
        (10, "DP-010", "main.sales.orders", "Published", None),     # lower-case: J6 no, J5 yes
        (11, "DP-011", "main.sales.items", "Published", None),
        (12, "DP-999", "main.gone.table", "Published", dt.datetime(2000, 1, 1)),
        (13, "DP-1200", None, "Draft", None)], PROD)


def test_registered_flag_is_case_sensitive_and_discovery_is_not(spark):
    flagged = {r["full_name"]: r["registered"] for r in M.registered_flag(_meta(spark), _prods(spark)).collect()}
    assert flagged == {"main.sales.Orders": False, "main.sales.items": True, "main.sales.__dlt_tmp": False,
                       "main.hr.people": False}
    listed = {r["full_name"] for r in M.list_tables(_meta(spark), _prods(spark)).collect()}
    assert "main.sales.__dlt_tmp" not in listed
    new = {r["full_name"] for r in M.undiscovered_tables(_meta(spark), _prods(spark)).collect()}
    assert new == {"main.sales.__dlt_tmp", "main.hr.people"}
    assert {r["full_name"] for r in M.undiscovered_tables(_meta(spark), _prods(spark), "main.sales.__").collect()} == {
        "main.sales.__dlt_tmp"}


def test_sync_marks_vanished_tables(spark):
    plan = M.sync_metadata(_prods(spark), _meta(spark), ts_ntz("2001-08-01 00:00:00"))
    got = {r["product_ref"]: (r["status"], r["sync"], r["last_refreshed"]) for r in plan.collect()}
    assert got["DP-999"] == ("Unavailable", "unavailable", dt.datetime(2000, 1, 1))
    assert got["DP-010"] == ("Published", "synced", dt.datetime(2001, 7, 1))
    assert "DP-1200" not in got
    c = M.sync_counters(plan).first()
    assert (c["synced"], c["unavailable"], c["total"]) == (2, 1, 3)


def test_assign_refs_continue_after_max_and_pad(spark):
    rows = spark.createDataFrame([("b.c.d",), ("a.b.c",)], "full_name string")
    got = {r["full_name"]: r["product_ref"] for r in M.assign_refs(rows, _prods(spark)).collect()}
    assert got == {"a.b.c": "DP-1201", "b.c.d": "DP-1202"}
    small = spark.createDataFrame([("DP-007",)], "product_ref string")
    assert {r["product_ref"] for r in M.assign_refs(rows, small).collect()} == {"DP-008", "DP-009"}
    nxt = C.next_product_ref(spark.createDataFrame([("DP-abc",), ("DP-041",)], "product_ref string")).first()
    assert (nxt["max_id"], nxt["next_ref"]) == (41, "DP-042")


def test_rollup_levels_and_check_state(spark):
    flagged = M.list_tables(_meta(spark), _prods(spark))
    sel = spark.createDataFrame([("main.sales.Orders",)], "full_name string")
    got = {(r["catalog_name"], r["schema_name"]): (r["tables"], r["unregistered"], r["selected"], r["check_state"])
           for r in M.registration_rollup(flagged, sel).collect()}
    assert got[("main", "sales")] == (2, 1, 1, "checked")
    assert got[("main", "hr")] == (1, 1, 0, "unchecked")
    assert got[("main", None)] == (3, 2, 1, "indeterminate")
    assert got[(None, None)] == (3, 2, 1, "indeterminate")


def test_catalog_page_offsets_and_total(spark):
    df = spark.range(1, 14).select(F.col("id").alias("product_id"), F.format_string("n%02d", "id").alias("name"))
    page = C.catalog_page(df, 3).collect()
    assert [r["product_id"] for r in page] == [13]
    assert page[0]["total_pages"] == 3


def test_month_layout_prunes_partitions(spark, tmp_path):
    from stewardlake.sources import catalog_io as IO

    df = spark.createDataFrame([(1, dt.datetime(2001, 1, 5)), (2, dt.datetime(2001, 2, 5)), (3, dt.datetime(2001, 3, 5))],
                               "id long, ts timestamp_ntz")
    IO.write_by_month(df, str(tmp_path / "t"), "ts")
    got = IO.read_months(spark, str(tmp_path / "t"), "2001-02", "2001-03")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan
    assert sorted(r["id"] for r in got.collect()) == [2, 3]


def test_top_domains_ties_follow_first_appearance(spark):
    df = spark.createDataFrame([("Zeta", "b"), ("Zeta", "c"), ("Alpha", "d"), ("Alpha", "e"), (None, "a")],
                               "domain string, display_name string")
    got = [r["domain"] for r in C.top_domains(df, 3).collect()]
    assert got == ["Zeta", "Alpha", "Other"]


def test_requests_of_placeholders_and_idle_users(spark):
    from stewardlake.operators import access as A

    prods = spark.createDataFrame([(1, "your_catalog.your_schema.t1"), (2, "main.sales.orders"), (3, None)],
                                  "product_id long, uc_full_name string")
    reqs = spark.createDataFrame([("r1", 1, 10), ("r2", 2, 11), ("r3", 3, 12), ("r4", 1, 13)],
                                 "request_id string, product_id long, requester_id long")
    got = sorted(r["request_id"] for r in A.requests_of_placeholders(reqs, prods, "your_catalog.your_schema.%").collect())
    assert got == ["r1", "r4"]
    users = spark.createDataFrame([(10,), (14,), (15,), (None,)], "user_id long")
    library = spark.createDataFrame([(15, 2)], "user_id long, product_id long")
    idle = sorted(r["user_id"] for r in A.idle_users(users, users, reqs, library).collect())
    assert idle == [14]


def test_all_tables_present_uses_catalog_listing(spark):
    from stewardlake.sources import catalog_io as IO

    expected = spark.createDataFrame([("sl_present_view",), ("sl_missing_table",)], "table_name string")
    spark.range(1).createOrReplaceTempView("sl_present_view")
    try:
        got = {r["table_name"] for r in IO.all_tables_present(spark, expected).collect()}
    finally:
        spark.catalog.dropTempView("sl_present_view")
    assert got == {"sl_missing_table"}


def test_catalog_access_summary_three_outcomes(spark):
    t = dt.datetime(2001, 7, 1)
    meta = spark.createDataFrame([
        ("system", "billing", "usage", "MANAGED", 1, t),                  # cannot list schemas
        ("main", "sales", "orders", "MANAGED", 2, t),
        ("main", "etl", "__dlt_stage", "MANAGED", 3, t),                   # needs a grant
        ("lake", "gold", "facts", "MANAGED", 4, t)], META)                 # accessible
    summary = M.catalog_access_summary(M.schema_visibility(meta))
    got = {r["catalog_name"]: r["access"] for r in summary.collect()}
    assert got == {"system": "no_access", "main": "needs_grant", "lake": "accessible"}
    lines = [r["grant_sql"] for r in M.catalog_grant_sql(summary, "sp-1").orderBy("line_no").collect()]
    assert lines == ["GRANT USE CATALOG ON CATALOG `main` TO `sp-1`;", "GRANT USE SCHEMA ON CATALOG `main` TO `sp-1`;",
                     "GRANT SELECT ON CATALOG `main` TO `sp-1`;"]


def test_column_tag_map_keeps_one_value_per_name(spark):
    cols = spark.createDataFrame([(1, "a", "string", 1), (1, "b", "string", 2)],
                                 "product_id long, column_name string, data_type string, ordinal_position int")
    tags = spark.createDataFrame([(1, "a", "sensitivity", "PII"), (1, "a", "sensitivity", "Internal"),
                                  (1, "a", "owner", "x")], "product_id long, column_name string, tag_name string, tag_value string")
    got = {r["column_name"]: r["tags"] for r in M.columns_with_tags(cols, tags).collect()}
    assert got["a"] == {"sensitivity": "PII", "owner": "x"} and got["b"] is None


def test_write_table_overwrites_and_partitions(spark, tmp_path):
    from stewardlake.sources import catalog_io as IO

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, grp string")
    out = str(tmp_path / "t")
    first = IO.write_table(df, out, partition_by=["grp"])
    assert first.count() == 3 and set(first.columns) == {"id", "grp"}
    again = IO.write_table(df.filter("id < 3"), out, partition_by=["grp"])
    assert sorted(r["id"] for r in again.collect()) == [1, 2]
