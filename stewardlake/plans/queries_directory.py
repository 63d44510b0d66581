"""Registered directory, library and source/sink queries
(P12, P13, L5, J7, J8, J11, J12, F2, M2 reject, M9 nudge, M11 settings, M21 groups, S3-S5, S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.sampling import stable_unit_sql
from ..operators import access as A
from ..operators import catalog as C
from ..operators import changes as CH
from ..operators import directory as DIR
from ..operators import governance as G
from ..operators import metadata as M
from ..session import checkpoint_subdir
from ..sources import catalog_io as IO
from ..sources.fixtures import tables
from .params import REQUESTS_AS_OF_TEXT, requests_as_of
from .queries_changes import UPSERT_INC, q_upsert_users as _signup_upsert
from .queries_metadata import CLASSIFIED, ELEV_RE, PII_RE
from .registry import register

AS_OF = f"TIMESTAMP '{REQUESTS_AS_OF_TEXT}'"
ROLE_SQL = "CASE WHEN lower(trim(role)) IN ('admin','steward','data_steward','data steward') THEN 'admin' ELSE 'analyst' END"


@register("elevated_pii", f"""WITH {CLASSIFIED}
SELECT product_id, column_name, sensitivity,
 sensitivity = 'PII' AND regexp_matches(column_name, '{PII_RE}') AND regexp_matches(column_name, '{ELEV_RE}') AS elevated_pii
FROM classified""")
def q_elevated_pii(spark, d):
    t = tables(spark, d)
    return M.classify_columns(M.columns_with_tags(t.meta_columns, t.meta_column_tags)).select(
        "product_id", "column_name", "sensitivity", "elevated_pii")


@register("users_search", "SELECT * FROM users WHERE contains(lower(COALESCE(display_name, '')), '00001') OR contains(lower(COALESCE(email, '')), '00001')")
def q_users_search(spark, d):
    return DIR.users_search(tables(spark, d).users, "00001")


@register("directory_search", """
SELECT * FROM (SELECT 'user' AS kind, display_name AS name, email, CAST(NULL AS BIGINT) AS member_count FROM users
  WHERE contains(lower(COALESCE(display_name, '')), 'in') OR contains(lower(COALESCE(email, '')), 'in') ORDER BY name, email LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'group', g.group_name, CAST(NULL AS VARCHAR), COALESCE(c.n, 0) FROM portal_groups g
  LEFT JOIN (SELECT department, count(*) AS n FROM users GROUP BY 1) c ON c.department = g.group_name
  WHERE contains(lower(g.group_name), 'in') ORDER BY g.group_name LIMIT 20)""")
def q_directory_search(spark, d):
    t = tables(spark, d)
    return DIR.directory_search(t.users, t.portal_groups, "in")


@register("users_sorted", f"SELECT user_id, email, display_name, {ROLE_SQL} AS role, department FROM users")
def q_users_sorted(spark, d):
    return DIR.users_sorted(tables(spark, d).users)


@register("groups_sorted", f"SELECT group_name, {ROLE_SQL} AS role FROM portal_groups")
def q_groups_sorted(spark, d):
    return DIR.groups_sorted(tables(spark, d).portal_groups)


# The listed accounts are those without a stored role, taken after the signup
# upsert (M10 batch), whose new accounts have no request and no library row yet.
@register("idle_demo_users", f"""WITH {UPSERT_INC},
after AS (
 SELECT u.user_id, u.email, CASE WHEN i.k IS NOT NULL THEN i.display_name ELSE u.display_name END AS display_name,
  CASE WHEN i.k IS NOT NULL THEN 'admin' ELSE u.role END AS role,
  CASE WHEN i.k IS NOT NULL THEN i.department ELSE u.department END AS department
 FROM users u LEFT JOIN inc i ON i.k = lower(trim(u.email))
 UNION ALL
 SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY k), k, display_name, COALESCE(role, 'analyst'),
  COALESCE(department, '')
 FROM inc WHERE k NOT IN (SELECT lower(trim(email)) FROM users))
SELECT * FROM after a
WHERE (a.role IS NULL OR a.user_id > (SELECT max(user_id) FROM users))
 AND NOT EXISTS (SELECT 1 FROM access_requests r WHERE r.requester_id = a.user_id)
 AND NOT EXISTS (SELECT 1 FROM user_library l WHERE l.user_id = a.user_id)""")
def q_idle_demo_users(spark, d):
    t = tables(spark, d)
    after = _signup_upsert(spark, d)
    max_id = t.users.select(F.max("user_id")).scalar()
    listed = after.filter(F.col("role").isNull() | (F.col("user_id") > max_id)).select("user_id")
    return A.idle_users(after, listed, t.access_requests, t.user_library)


@register("requests_of_placeholders", """
SELECT * FROM access_requests WHERE product_id IN (SELECT product_id FROM data_products WHERE uc_full_name LIKE 'your_catalog.your_schema.%')""")
def q_requests_of_placeholders(spark, d):
    t = tables(spark, d)
    return A.requests_of_placeholders(t.access_requests, t.data_products, "your_catalog.your_schema.%")


# Every purchase event names a product ref; every error event names a ref that does not exist.
@register("enrich_matches", """
WITH m AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'DP-' || lpad(regexp_extract(props, '[0-9]+', 0), 3, '0')
                                 ELSE 'DP-9' || regexp_extract(props, '[0-9]+', 0) END AS ref FROM events WHERE event_type IN ('purchase', 'error'))
SELECT m.ref, m.event_id, p.product_id, p.display_name, p.domain, p.type FROM m
JOIN (SELECT * FROM data_products WHERE is_active AND COALESCE(status, 'Published') = 'Published') p ON p.product_ref = m.ref""")
def q_enrich_matches(spark, d):
    t = tables(spark, d)
    k = F.regexp_extract("props", "[0-9]+", 0)
    m = t.raw("events").filter(F.col("event_type").isin("purchase", "error")).select(
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("DP-"), F.lpad(k, 3, "0")))
        .otherwise(F.concat(F.lit("DP-9"), k)).alias("ref"), "event_id")
    return A.enrich_matches(m, C.catalog_published(t.data_products))


@register("library_dedupe", """
WITH items AS (
 SELECT l.user_id, l.product_id, 'pinned' AS source, 'Approved' AS status, CAST(NULL AS VARCHAR) AS request_id FROM user_library l
 WHERE NOT EXISTS (SELECT 1 FROM access_requests r WHERE r.requester_id = l.user_id AND r.product_id = l.product_id)
 UNION ALL SELECT requester_id, product_id, 'request', status, request_id FROM access_requests)
SELECT i.*, p.product_ref, p.display_name AS name FROM items i JOIN data_products p ON p.product_id = i.product_id""")
def q_library_dedupe(spark, d):
    t = tables(spark, d)
    return A.library_dedupe(t.user_library, t.access_requests, t.data_products)


@register("reject_products", f"""
SELECT product_id, product_ref, is_active, CASE WHEN status = 'Pending' THEN 'Rejected' ELSE status END AS status,
 CASE WHEN status = 'Pending' THEN {AS_OF} END AS updated_at FROM data_products""")
def q_reject_products(spark, d):
    t = tables(spark, d)
    dec = t.data_products.filter(F.col("status") == "Pending").select(
        "product_ref", F.lit("reject").alias("action"), requests_as_of().alias("decided_at"))
    return CH.review_products(t.data_products, dec, requests_as_of()).select(
        "product_id", "product_ref", "is_active", "status", "updated_at")


@register("nudge", f"""
SELECT 'NUDGE_SENT' AS event_type, requester_id AS actor_id,
 '{{"request_id":"' || request_id || '","message":"Requester sent a reminder to approver"}}' AS metadata, {AS_OF} AS occurred_at
FROM access_requests WHERE status = 'Pending' AND requested_at < {AS_OF} - INTERVAL '30' DAY AND requester_id IN (SELECT user_id FROM users)""")
def q_nudge(spark, d):
    t = tables(spark, d)
    return G.nudge_events(t.access_requests, t.users, requests_as_of())


# M11 settings: current = one counter per event type; incoming = one per document language
# plus an overwrite of the 'view' key.
@register("upsert_settings", f"""
WITH cur AS (SELECT event_type AS key, CAST(count(*) AS VARCHAR) AS value, CAST(NULL AS TIMESTAMP) AS updated_at FROM events GROUP BY 1),
inc AS (SELECT 'lang_' || lang AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY 1
        UNION ALL SELECT 'view', 'overwritten')
SELECT * FROM cur WHERE key NOT IN (SELECT key FROM inc) UNION ALL SELECT key, value, {AS_OF} FROM inc""")
def q_upsert_settings(spark, d):
    t = tables(spark, d)
    cur = t.raw("events").groupBy(F.col("event_type").alias("key")).agg(
        F.count(F.lit(1)).cast("string").alias("value")).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    inc = t.documents.groupBy(F.concat(F.lit("lang_"), "lang").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value")) \
        .unionByName(spark.range(1).select(F.lit("view").alias("key"), F.lit("overwritten").alias("value")))
    return CH.upsert_settings(cur, inc, requests_as_of())


# Groups whose role is 'analyst' are deleted.
@register("delete_groups", "SELECT * FROM portal_groups WHERE role <> 'analyst'")
def q_delete_groups(spark, d):
    t = tables(spark, d)
    names = t.portal_groups.filter(F.col("role") == "analyst").select("group_name")
    return CH.delete_groups(t.portal_groups, names)


# Registered tables the metastore does not have (expected set minus existing).
@register("all_tables_present", """
SELECT uc_full_name AS table_name FROM data_products WHERE uc_full_name IS NOT NULL
EXCEPT SELECT catalog_name || '.' || schema_name || '.' || table_name FROM meta_tables""")
def q_all_tables_present(spark, d):
    t = tables(spark, d)
    expected = t.data_products.filter(F.col("uc_full_name").isNotNull()).select(F.col("uc_full_name").alias("table_name"))
    existing = t.meta_tables.select(M.full_name().alias("table_name"))
    return IO.all_tables_present(spark, expected, existing)


def _pick_sql(values, u):
    arr = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"{arr}[CAST(floor(({u}) * {len(values)}) AS INTEGER) + 1]"


def _u(key, salt, seed=42):
    return stable_unit_sql(key, seed, salt)


@register("gen_revenue_summary", f"""
SELECT o_orderkey AS record_id,
 {_pick_sql(IO.BUSINESS_UNITS, _u('o_orderkey', 1))} AS business_unit,
 {_pick_sql(IO.REVENUE_REGIONS, _u('o_orderkey', 2))} AS region,
 {AS_OF} - CAST(floor({_u('o_orderkey', 3)} * 365) AS INTEGER) * INTERVAL '1' DAY AS period_date,
 round(50000 + {_u('o_orderkey', 4)} * 4950000, 2) AS budgeted_amount,
 round(40000 + {_u('o_orderkey', 5)} * 4760000, 2) AS actual_amount
FROM orders""")
def q_gen_revenue_summary(spark, d):
    seed = tables(spark, d).raw("orders").select(F.col("o_orderkey").alias("record_id"))
    return IO.gen_revenue_summary(seed, requests_as_of())


@register("gen_service_requests", f"""
SELECT request_id, printf('SR-%05d', request_id) AS request_number,
 {_pick_sql(IO.SR_CATEGORIES, _u('request_id', 1))} AS category,
 {_pick_sql(IO.SR_PRIORITIES, _u('request_id', 2))} AS priority,
 {_pick_sql(IO.SR_STATUSES, _u('request_id', 3))} AS status,
 {AS_OF} - CAST(floor({_u('request_id', 4)} * 180) AS INTEGER) * INTERVAL '1' DAY AS created_at,
 CASE WHEN {_u('request_id', 5)} < 0.3 THEN NULL ELSE CAST(floor({_u('request_id', 6)} * 30) + 1 AS INTEGER) END AS resolution_days
FROM (SELECT event_id + 1 AS request_id FROM events)""")
def q_gen_service_requests(spark, d):
    seed = tables(spark, d).raw("events").select((F.col("event_id") + 1).alias("request_id"))
    return IO.gen_service_requests(seed, requests_as_of())


# The aligned catalog written as a table under the shared checkpoint folder and read back.
@register("write_table", f"""
SELECT product_id, product_ref, display_name, COALESCE(source_system, '{rules.DEFAULT_SOURCE_TYPE}') AS source_type, status FROM data_products""")
def q_write_table(spark, d):
    import uuid

    df = C.align_schema(tables(spark, d).data_products).select(
        "product_id", "product_ref", "display_name", "source_type", "status")
    return IO.write_table(df, checkpoint_subdir(spark, f"table-data_products-{uuid.uuid4().hex[:12]}"))


# S5 with time layout: requests stored by request month, then one quarter read back (pruned).
@register("requests_by_month", """
SELECT request_id, product_id, requester_id, status, requested_at, strftime(requested_at, '%Y-%m') AS ym
FROM access_requests WHERE strftime(requested_at, '%Y-%m') BETWEEN '1998-01' AND '1998-03'""")
def q_requests_by_month(spark, d):
    import uuid

    req = tables(spark, d).access_requests.select("request_id", "product_id", "requester_id", "status", "requested_at")
    path = checkpoint_subdir(spark, f"table-access_requests-{uuid.uuid4().hex[:12]}")
    IO.write_by_month(req, path, "requested_at")
    return IO.read_months(spark, path, "1998-01", "1998-03")
