"""Registered table-change queries.

Each change batch is derived from the fixture tables (documented per key), so
the work grows with the data. A mutation's result is the changed table (or,
for multi-table deletes, the new row counts of each table).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import access as A
from ..operators import changes as CH
from ..operators import metadata as M
from ..operators import refusals as R
from ..operators.governance import user_group_role
from ..session import checkpoint_subdir
from ..sources import catalog_io as IO
from ..sources.bucketed import BucketedTable
from ..sources.fixtures import days, tables
from .params import REQUESTS_AS_OF_TEXT, STEWARD_EMAIL, requests_as_of
from .queries_governance import _grant_sql_sql
from .queries_metadata import word_caps_sql
from .registry import register

AS_OF = f"TIMESTAMP '{REQUESTS_AS_OF_TEXT}'"
MAX_REF = "(SELECT COALESCE(max(TRY_CAST(substring(product_ref, 4) AS INTEGER)), 0) FROM data_products)"


# M1 batch: each user turn of a conversation submits a product (whole text as description).
@register("register_products", f"""
WITH sub AS (SELECT (conv_id, turn) AS submission_id, 'Request ' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS name,
  text AS description, 'user' || CAST(conv_id AS VARCHAR) || '@example.org' AS submitted_by FROM conversations WHERE role = 'user'),
ok AS (SELECT * FROM sub WHERE NULLIF(trim(name), '') IS NOT NULL AND NULLIF(trim(description), '') IS NOT NULL)
SELECT name AS display_name, description, 'Dashboard' AS type, 'Other' AS source_system, 'user' AS tags, 'Daily' AS refresh_frequency,
 submitted_by AS owner_email, 'Internal' AS classification, '' AS uc_full_name, 'Other' AS domain, FALSE AS is_active, 'Pending' AS status,
 printf('DP-%03d', {MAX_REF} + row_number() OVER (ORDER BY submission_id)) AS product_ref
FROM ok""")
def q_register_products(spark, d):
    t = tables(spark, d)
    sub = t.conversations.filter(F.col("role") == "user").select(
        F.format_string("%020d-%020d", "conv_id", "turn").alias("submission_id"),
        F.concat(F.lit("Request "), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("name"),
        F.col("text").alias("description"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("source"),
        F.lit("user").alias("tags"), F.lit(None).cast("string").alias("refresh_frequency"),
        F.lit(None).cast("string").alias("owner_email"),
        F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.org")).alias("submitted_by"),
        F.lit(None).cast("string").alias("domain"))
    return CH.register_products(t.data_products, sub, requests_as_of())["new_products"]


# M2 batch: every pending product; Datasets are published, the others rejected.
@register("publish_products", f"""
SELECT product_id, product_ref, CASE WHEN status = 'Pending' AND type = 'Dataset' THEN TRUE ELSE is_active END AS is_active,
 CASE WHEN status = 'Pending' THEN CASE WHEN type = 'Dataset' THEN 'Published' ELSE 'Rejected' END ELSE status END AS status,
 CASE WHEN status = 'Pending' THEN {AS_OF} END AS updated_at FROM data_products""")
def q_publish_products(spark, d):
    t = tables(spark, d)
    dec = t.data_products.filter(F.col("status") == "Pending").select(
        "product_ref", F.when(F.col("type") == "Dataset", "publish").otherwise("reject").alias("action"),
        requests_as_of().alias("decided_at"))
    out = CH.review_products(t.data_products, dec, requests_as_of())
    return out.select("product_id", "product_ref", "is_active", "status", "updated_at")


# M3 batch: two patches of every Report. The first sets a domain and an owner, the second lower-cases the
# domain, sets source_type of weekly Reports and the description of annual ones to NULL (an explicit NULL):
# the later domain counts, the earlier owner stays.
@register("patch_products", f"""
SELECT product_id, product_ref, display_name,
 CASE WHEN type = 'Report' AND refresh_frequency = 'Annual' THEN NULL ELSE description END AS description, type,
 CASE WHEN type = 'Report' THEN lower(domain) ELSE domain END AS domain, refresh_frequency,
 CASE WHEN type = 'Report' AND refresh_frequency = 'Weekly' THEN 'Snowflake' ELSE source_system END AS source_system,
 CASE WHEN type = 'Report' THEN 'patched@example.org' END AS owner_email,
 CASE WHEN type = 'Report' THEN {AS_OF} END AS updated_at
FROM data_products""")
def q_patch_products(spark, d):
    t = tables(spark, d)
    p = t.data_products
    reports = p.filter(F.col("type") == "Report")
    second = reports.select(
        "product_ref", F.lit(2).alias("patch_seq"),
        F.lit(True).alias("has_domain"), F.lower("domain").alias("domain"),
        (F.col("refresh_frequency") == "Weekly").alias("has_source_type"), F.lit("Snowflake").alias("source_type"),
        (F.col("refresh_frequency") == "Annual").alias("has_description"), F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("has_owner_email"), F.lit("zzz@example.org").alias("owner_email"))
    first = reports.select(
        "product_ref", F.lit(1).alias("patch_seq"), F.lit(True).alias("has_domain"), F.lit("zzz").alias("domain"),
        F.lit(True).alias("has_owner_email"), F.lit("patched@example.org").alias("owner_email"))
    out = CH.patch_products(p, second.unionByName(first, allowMissingColumns=True), requests_as_of())
    return out.select("product_id", "product_ref", "display_name", "description", "type", "domain", "refresh_frequency",
                      "source_system", "owner_email", "updated_at")


# M2 audit: one row per reviewed product of the publish / reject batch.
@register("review_audit", f"""
SELECT CASE WHEN type = 'Dataset' THEN 'PRODUCT_PUBLISHED' ELSE 'PRODUCT_REJECTED' END AS event_type, 'admin' AS actor_email,
 product_ref AS target_name, {AS_OF} AS occurred_at FROM data_products WHERE status = 'Pending'""")
def q_review_audit(spark, d):
    p = tables(spark, d).data_products
    pending = p.filter(F.col("status") == "Pending")
    dec = pending.select("product_ref", F.when(F.col("type") == "Dataset", "publish").otherwise("reject").alias("action"),
                         requests_as_of().alias("decided_at"))
    older = pending.select("product_ref", F.when(F.col("type") == "Dataset", "reject").otherwise("publish").alias("action"),
                           (requests_as_of() - days(1)).alias("decided_at"))
    return CH.review_audit(p, dec.unionByName(older), requests_as_of()).select(
        "event_type", "actor_email", "target_name", "occurred_at")


# M4 batch: every Pending product is deleted.
@register("delete_products", """
WITH gone AS (SELECT product_id FROM data_products WHERE status = 'Pending')
SELECT 'data_products' AS table_name, count(*) AS n_rows FROM data_products WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'access_requests', count(*) FROM access_requests WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'audit_log', count(*) FROM audit_log
 WHERE TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT) IS NULL
    OR TRY_CAST(json_extract_string(metadata, '$.k') AS BIGINT) NOT IN (SELECT product_id FROM gone)
UNION ALL SELECT 'user_library', count(*) FROM user_library WHERE product_id NOT IN (SELECT product_id FROM gone)""")
def q_delete_products(spark, d):
    t = tables(spark, d)
    refs = t.data_products.filter(F.col("status") == "Pending").select("product_ref")
    out = CH.delete_products(refs, t.data_products, t.access_requests, t.audit_log, t.user_library)
    return IO.table_row_counts(out)


# M5 batch: each 'view' event submits a request for product k by that customer; each 'signup'
# event submits one from a new e-mail (the user is created first).
SUBMIT_SQL = f"""
sub AS (
 SELECT event_id AS submission_id, 'DP-' || lpad(regexp_extract(props, '[0-9]+', 0), greatest(3, length(regexp_extract(props, '[0-9]+', 0)))::int, '0') AS product_ref,
  CASE WHEN event_type = 'view' THEN 'customer.' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.org'
       ELSE 'signup' || CAST(user_id AS VARCHAR) || '@example.org' END AS requester_email, event_type AS reason
 FROM events WHERE event_type IN ('view', 'signup')),
known AS (SELECT s.*, p.product_id FROM sub s JOIN data_products p ON p.product_ref = s.product_ref),
newu AS (
 SELECT k, (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY k) AS user_id
 FROM (SELECT DISTINCT lower(trim(requester_email)) AS k FROM known) WHERE k NOT IN (SELECT lower(trim(email)) FROM users)),
allu AS (SELECT lower(trim(email)) AS k, user_id, department FROM users UNION ALL SELECT k, user_id, 'General' FROM newu)"""


def _padded_ref(number):
    """The mapping's reference: three digits at least, longer numbers whole."""
    return F.concat(F.lit("DP-"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


@register("submit_requests", f"""WITH {SUBMIT_SQL}
SELECT md5(requester_email || '|' || product_ref || '|' || CAST(submission_id AS VARCHAR)) AS request_id, product_id,
 u.user_id AS requester_id, reason AS business_reason, 'Pending' AS status, {AS_OF} AS requested_at, u.department AS requester_team
FROM known JOIN allu u ON u.k = lower(trim(known.requester_email))""")
def q_submit_requests(spark, d):
    t = tables(spark, d)
    ev = t.raw("events").filter(F.col("event_type").isin("view", "signup"))
    sub = ev.select(
        F.col("event_id").alias("submission_id"),
        _padded_ref(F.regexp_extract("props", "[0-9]+", 0)).alias("product_ref"),
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("customer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.org")))
        .otherwise(F.concat(F.lit("signup"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("requester_email"),
        F.lit(None).cast("string").alias("team"),
        F.col("event_type").alias("reason"))
    out = CH.submit_requests(t.access_requests, t.users, t.data_products, sub, requests_as_of())
    return out["new_requests"].select(
        "request_id", "product_id", "requester_id", "business_reason", "status", "requested_at", "requester_team")


@register("upsert_users_on_submit", f"""WITH {SUBMIT_SQL}
SELECT user_id, email, display_name, role, department FROM users
UNION ALL
SELECT n.user_id, n.k AS email,
 {word_caps_sql("regexp_replace(split_part(n.k, '@', 1), '^([^.]*)\\.', '\\1 ')")} AS display_name, 'analyst', 'General' FROM newu n""")
def q_upsert_users_on_submit(spark, d):
    t = tables(spark, d)
    ev = t.raw("events").filter(F.col("event_type").isin("view", "signup"))
    sub = ev.select(
        F.col("event_id").alias("submission_id"),
        _padded_ref(F.regexp_extract("props", "[0-9]+", 0)).alias("product_ref"),
        F.when(F.col("event_type") == "view",
               F.concat(F.lit("customer."), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@example.org")))
        .otherwise(F.concat(F.lit("signup"), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("requester_email"),
        F.lit(None).cast("string").alias("team"),
        F.col("event_type").alias("reason"))
    return CH.submit_requests(t.access_requests, t.users, t.data_products, sub, requests_as_of())["users"].select(
        "user_id", "email", "display_name", "role", "department")


# M6 batch: the requester decides first (in capitals; the guard refuses it), then the steward, then another
# person whose name sorts last. The first decision that passes the guard counts.
DECISIONS = f"""dec AS (
 SELECT ar.request_id, x.seq, CASE x.seq WHEN 1 THEN upper(u.email) WHEN 2 THEN '{STEWARD_EMAIL}' ELSE 'zz@example.org' END AS approver_email
 FROM access_requests ar JOIN users u ON u.user_id = ar.requester_id, (VALUES (1), (2), (3)) x(seq)
 WHERE NOT (x.seq = 2 AND u.department = 'BUILDING')),
valid AS (
 SELECT d.* FROM dec d JOIN access_requests r ON r.request_id = d.request_id
 LEFT JOIN users u ON u.user_id = r.requester_id
 WHERE NOT COALESCE(lower(u.email) = lower(d.approver_email), FALSE) AND NOT (r.status IS NOT NULL AND r.status <> 'Pending')),
ok AS (SELECT request_id, arg_min(approver_email, seq) AS approver_email FROM valid GROUP BY request_id)"""


def _decisions(t):
    who = t.access_requests.join(t.users.withColumnRenamed("user_id", "requester_id"), "requester_id")
    seq = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("decided_at")
    dec = who.select("request_id", "department", F.upper("email").alias("own"), seq)
    return dec.filter(~((F.col("decided_at") == 2) & (F.col("department") == "BUILDING"))).select(
        "request_id", "decided_at",
        F.when(F.col("decided_at") == 1, F.col("own")).when(F.col("decided_at") == 2, STEWARD_EMAIL)
        .otherwise("zz@example.org").alias("approver_email"))


@register("approve_requests", f"""WITH {DECISIONS},
g AS (SELECT DISTINCT ok.request_id, (SELECT min(user_id) FROM users WHERE email = ok.approver_email) AS approver_id,
       {_grant_sql_sql('dp.uc_full_name', 'u.email', 'dp.display_name')} AS grant_sql
      FROM ok JOIN access_requests ar ON ar.request_id = ok.request_id JOIN data_products dp ON dp.product_id = ar.product_id
      JOIN users u ON u.user_id = ar.requester_id)
SELECT ar.request_id, CASE WHEN g.request_id IS NOT NULL THEN 'Approved' ELSE ar.status END AS status,
 CASE WHEN g.request_id IS NOT NULL THEN {AS_OF} ELSE ar.resolved_at END AS resolved_at,
 CASE WHEN g.request_id IS NOT NULL THEN g.approver_id END AS resolved_by,
 CASE WHEN g.request_id IS NOT NULL THEN g.grant_sql END AS uc_grant_sql,
 CASE WHEN g.request_id IS NOT NULL THEN TRUE END AS uc_grant_issued,
 CASE WHEN g.request_id IS NOT NULL THEN {AS_OF} + INTERVAL '90' DAY ELSE ar.expires_at END AS expires_at,
 CASE WHEN g.request_id IS NOT NULL THEN {AS_OF} END AS updated_at
FROM access_requests ar LEFT JOIN g ON g.request_id = ar.request_id""")
def q_approve_requests(spark, d):
    t = tables(spark, d)
    out = CH.approve_requests(t.access_requests, t.users, t.data_products, _decisions(t), requests_as_of())
    return out.select("request_id", "status", "resolved_at", "resolved_by", "uc_grant_sql", "uc_grant_issued", "expires_at",
                      "updated_at")


# M6-M8 audit: one row per decided request, all three kinds.
@register("decision_audit", f"""WITH {DECISIONS}
SELECT 'REQUEST_APPROVED' AS event_type, approver_email AS actor_email, request_id AS target_name, {AS_OF} AS occurred_at FROM ok
UNION ALL SELECT 'REQUEST_DENIED', '{STEWARD_EMAIL}', request_id, {AS_OF} FROM access_requests
 WHERE status = 'Pending' AND business_reason = '5-LOW'
UNION ALL SELECT 'ACCESS_REVOKED', '{STEWARD_EMAIL}', request_id, {AS_OF} FROM access_requests
 WHERE status = 'Approved' AND business_reason = '1-URGENT'""")
def q_decision_audit(spark, d):
    t = tables(spark, d)
    out = CH.approvals(t.access_requests, t.users, t.data_products, _decisions(t), requests_as_of())["audit"]
    out = out.unionByName(CH.denials(t.access_requests, t.users, _denials(t), requests_as_of())["audit"])
    out = out.unionByName(CH.revocations(t.access_requests, _revocations(t), requests_as_of())["audit"])
    return out.select("event_type", "actor_email", "target_name", "occurred_at")


# M7 batch: pending low-priority requests are denied by the steward, first for one reason, then as stale.
def _denials(t):
    low = t.access_requests.filter((F.col("status") == "Pending") & (F.col("business_reason") == "5-LOW"))
    return low.select("request_id", F.lit(STEWARD_EMAIL).alias("approver_email"), F.inline(F.array(
        F.struct(F.lit(1).alias("decided_at"), F.lit("zz first reason").alias("reason")),
        F.struct(F.lit(2).alias("decided_at"), F.lit("stale").alias("reason")))))


@register("deny_requests", f"""
SELECT request_id, CASE WHEN hit THEN 'Denied' ELSE status END AS status, CASE WHEN hit THEN {AS_OF} ELSE resolved_at END AS resolved_at,
 CAST(NULL AS BIGINT) AS resolved_by, CASE WHEN hit THEN 'stale' END AS denial_reason, CASE WHEN hit THEN {AS_OF} END AS updated_at
FROM (SELECT *, status = 'Pending' AND business_reason = '5-LOW' AS hit FROM access_requests)""")
def q_deny_requests(spark, d):
    t = tables(spark, d)
    out = CH.deny_requests(t.access_requests, t.users, _denials(t), requests_as_of())
    return out.select("request_id", "status", "resolved_at", "resolved_by", "denial_reason", "updated_at")


# M8 batch: approved urgent requests are revoked, first with a reason, then with the default one.
def _revocations(t):
    urgent = t.access_requests.filter((F.col("status") == "Approved") & (F.col("business_reason") == "1-URGENT"))
    return urgent.select("request_id", F.lit(STEWARD_EMAIL).alias("approver_email"), F.inline(F.array(
        F.struct(F.lit(1).alias("decided_at"), F.lit("zz first reason").alias("reason")),
        F.struct(F.lit(2).alias("decided_at"), F.lit(None).cast("string").alias("reason")))))


@register("revoke_requests", f"""
SELECT request_id, CASE WHEN hit THEN 'Revoked' ELSE status END AS status, CASE WHEN hit THEN {AS_OF} ELSE resolved_at END AS resolved_at,
 CASE WHEN hit THEN 'Access revoked by administrator' END AS denial_reason,
 CASE WHEN hit THEN '-- No UC table linked; manual revocation required' END AS uc_grant_sql, expires_at,
 CASE WHEN hit THEN {AS_OF} END AS updated_at
FROM (SELECT *, status = 'Approved' AND business_reason = '1-URGENT' AS hit FROM access_requests)""")
def q_revoke_requests(spark, d):
    t = tables(spark, d)
    out = CH.revoke_requests(t.access_requests, _revocations(t), requests_as_of())
    return out.select("request_id", "status", "resolved_at", "denial_reason", "uc_grant_sql", "expires_at", "updated_at")


# M10 batch: each 'signup' event upserts a profile: existing customers become stewards of 'SIGNUP',
# plus a new user per signing-up id (overwrite mode). An earlier row of each has a name that sorts last.
UPSERT_INC = """inc AS (
 SELECT DISTINCT k, display_name, role, department FROM (
  SELECT lower(trim('customer.' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.org')) AS k,
   'Signed Up ' || CAST(user_id AS VARCHAR) AS display_name, 'steward' AS role, 'SIGNUP' AS department FROM events WHERE event_type = 'signup'
  UNION ALL
  SELECT lower(trim('new' || CAST(user_id AS VARCHAR) || '@example.org')), 'New ' || CAST(user_id AS VARCHAR), NULL, NULL
  FROM events WHERE event_type = 'signup'))"""


@register("upsert_users", f"""WITH {UPSERT_INC}
SELECT u.user_id, u.email, CASE WHEN i.k IS NOT NULL THEN i.display_name ELSE u.display_name END AS display_name,
 CASE WHEN i.k IS NOT NULL THEN 'admin' ELSE u.role END AS role, CASE WHEN i.k IS NOT NULL THEN i.department ELSE u.department END AS department
FROM users u LEFT JOIN inc i ON i.k = lower(trim(u.email))
UNION ALL
SELECT (SELECT max(user_id) FROM users) + row_number() OVER (ORDER BY k), k, display_name, COALESCE(role, 'analyst'), COALESCE(department, '')
FROM inc WHERE k NOT IN (SELECT lower(trim(email)) FROM users)""")
def q_upsert_users(spark, d):
    t = tables(spark, d)
    ev = t.raw("events").filter(F.col("event_type") == "signup")
    uid = F.col("user_id").cast("string")
    inc = ev.select(
        F.concat(F.lit("customer."), F.lpad(uid, 9, "0"), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("Signed Up "), uid).alias("display_name"), F.lit("steward").alias("role"),
        F.lit("SIGNUP").alias("department")).unionByName(ev.select(
            F.concat(F.lit("new"), uid, F.lit("@example.org")).alias("email"), F.concat(F.lit("New "), uid).alias("display_name"),
            F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("department"))).distinct()
    inc = inc.withColumn("upsert_seq", F.lit(2))
    older = inc.select("email", F.lit("zz older name").alias("display_name"), F.lit("viewer").alias("role"),
                       F.lit("ZZ").alias("department"), F.lit(1).alias("upsert_seq"))
    return CH.upsert_users(t.users, inc.unionByName(older), mode="overwrite").select("user_id", "email", "display_name", "role", "department")


# M11 batch: every customer segment is upserted as an analyst group.
@register("upsert_groups", """
SELECT group_name, role FROM portal_groups WHERE group_name NOT IN (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL SELECT DISTINCT c_mktsegment, 'analyst' FROM customer""")
def q_upsert_groups(spark, d):
    t = tables(spark, d)
    inc = t.raw("customer").select(F.col("c_mktsegment").alias("group_name"), F.lit("analyst").alias("role")).distinct()
    older = inc.select("group_name", F.lit("steward").alias("role"), F.lit(1).alias("upsert_seq"))
    return CH.upsert_groups(t.portal_groups, inc.withColumn("upsert_seq", F.lit(2)).unionByName(older))


@register("migrate_roles", """
SELECT user_id, email, CASE role WHEN 'steward' THEN 'admin' WHEN 'data_steward' THEN 'admin' WHEN 'manager' THEN 'analyst' ELSE role END AS role
FROM users""")
def q_migrate_roles(spark, d):
    t = tables(spark, d)
    return CH.migrate_roles(t.users, t.portal_groups)["users"].select("user_id", "email", "role")


@register("migrate_group_roles", """
SELECT group_name, CASE role WHEN 'steward' THEN 'admin' WHEN 'data_steward' THEN 'admin' WHEN 'manager' THEN 'admin' ELSE role END AS role
FROM portal_groups""")
def q_migrate_group_roles(spark, d):
    t = tables(spark, d)
    return CH.migrate_roles(t.users, t.portal_groups)["portal_groups"]


@register("fill_defaults", f"SELECT product_id, COALESCE(status, 'Published') AS status, COALESCE(source_system, '{rules.DEFAULT_SOURCE_TYPE}') AS source_system FROM data_products")
def q_fill_defaults(spark, d):
    return CH.fill_defaults(tables(spark, d).data_products).select("product_id", "status", "source_system")


SEED_REFS = ["DP-001", "DP-020", "DP-040"]


@register("reset_workflow", """
SELECT * FROM audit_log WHERE event_type NOT IN ('REQUEST_SUBMITTED','REQUEST_APPROVED','REQUEST_DENIED','ACCESS_REVOKED','NUDGE_SENT')""")
def q_reset_workflow(spark, d):
    t = tables(spark, d)
    return CH.reset_workflow(t.access_requests, t.audit_log, t.data_products, SEED_REFS)["audit_log"]


@register("reset_products", """
SELECT product_id, product_ref, status FROM data_products
WHERE NOT (COALESCE(status, '') IN ('Pending', 'Rejected') AND product_ref NOT IN ('DP-001', 'DP-020', 'DP-040'))""")
def q_reset_products(spark, d):
    t = tables(spark, d)
    return CH.reset_workflow(t.access_requests, t.audit_log, t.data_products, SEED_REFS)["data_products"].select(
        "product_id", "product_ref", "status")


# Demo reset: the seed users are two fixed accounts, new to the users table, and customer 1 under another name, who stays
# as stored.
SEED_USERS = [("analyst@example.org", "Alex Analyst", "analyst", "Finance"),
              ("datasteward@example.org", "Dana Steward", "admin", "Data Governance"),
              ("Customer.000000001@example.org", "Someone Else", "admin", "General")]
SEED_USERS_SQL = ", ".join(f"('{e}', '{n}', '{r}', '{d}')" for e, n, r, d in SEED_USERS)
NEW_SEEDS = f"""seeds AS (SELECT lower(trim(email)) AS email, display_name, role, department
 FROM (VALUES {SEED_USERS_SQL}) v(email, display_name, role, department)
 WHERE lower(trim(email)) NOT IN (SELECT lower(trim(email)) FROM users WHERE email IS NOT NULL))"""


def _demo_reset(spark, d):
    t = tables(spark, d)
    before = {"access_requests": t.access_requests, "audit_log": t.audit_log, "user_library": t.user_library,
              "data_products": t.data_products, "users": t.users}
    seeds = spark.createDataFrame(SEED_USERS, "email string, display_name string, role string, department string")
    return before, CH.reset_demo(*before.values(), SEED_REFS, seeds)


@register("demo_reset", f"""WITH {NEW_SEEDS}
SELECT 'access_requests' AS table_name, (SELECT count(*) FROM access_requests) AS n_before, 0 AS n_after
UNION ALL SELECT 'audit_log', (SELECT count(*) FROM audit_log), 0
UNION ALL SELECT 'user_library', (SELECT count(*) FROM user_library), 0
UNION ALL SELECT 'data_products', (SELECT count(*) FROM data_products), (SELECT count(*) FROM data_products
  WHERE COALESCE(status, 'Published') NOT IN ('Pending', 'Rejected') OR product_ref IS NULL
     OR product_ref IN ('DP-001', 'DP-020', 'DP-040'))
UNION ALL SELECT 'users', (SELECT count(*) FROM users), (SELECT count(*) FROM users) + (SELECT count(*) FROM seeds)""")
def q_demo_reset(spark, d):
    before, after = _demo_reset(spark, d)
    n = CH.table_counts(before).withColumnRenamed("n_rows", "n_before")
    return n.join(CH.table_counts(after).withColumnRenamed("n_rows", "n_after"), "table_name")


@register("demo_reset_users", f"""WITH {NEW_SEEDS}
SELECT user_id, email, display_name, role, department FROM users
UNION ALL SELECT (SELECT COALESCE(max(user_id), 0) FROM users) + row_number() OVER (ORDER BY email), email, display_name, role, department
FROM seeds""")
def q_demo_reset_users(spark, d):
    return _demo_reset(spark, d)[1]["users"].select("user_id", "email", "display_name", "role", "department")


# The admin list is every user of the FURNITURE segment.
@register("resolve_roles", """
WITH gr AS (SELECT user_id, role AS group_role FROM (
  SELECT u.user_id, g.group_name, g.role, row_number() OVER (PARTITION BY u.user_id ORDER BY
   CASE WHEN lower(g.role) = 'admin' THEN 0 WHEN lower(g.role) = 'steward' THEN 1 ELSE 2 END, g.group_name, g.role) AS rn
  FROM users u JOIN portal_groups g ON g.group_name = u.department) WHERE rn = 1)
SELECT u.user_id, u.email, u.role, gr.group_role,
 CASE WHEN u.department = 'FURNITURE' THEN 'admin'
      WHEN gr.group_role IS NOT NULL THEN CASE WHEN lower(trim(gr.group_role)) IN ('admin','steward','data_steward','data steward') THEN 'admin' ELSE 'analyst' END
      ELSE CASE WHEN lower(trim(u.role)) IN ('admin','steward','data_steward','data steward') THEN 'admin' ELSE 'analyst' END END AS resolved_role
FROM users u LEFT JOIN gr ON gr.user_id = u.user_id""")
def q_resolve_roles(spark, d):
    t = tables(spark, d)
    admins = t.users.filter(F.col("department") == "FURNITURE").select("email")
    return CH.resolve_roles(t.users, admins, user_group_role(t.users, t.portal_groups))


# M21 batch: each 'error' event edits its user: role admin when value > 50 (else empty = unchanged),
# a new display name; of each field the last edit (largest event id) that supplies it wins.
@register("edit_users", """
WITH e AS (
  SELECT user_id, CASE WHEN bool_or(value > 50) THEN 'admin' END AS role,
   'Edited ' || CAST(max(event_id) AS VARCHAR) AS display_name FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT u.user_id, u.email, COALESCE(e.display_name, u.display_name) AS display_name, COALESCE(e.role, u.role) AS role, u.department
FROM users u LEFT JOIN e ON e.user_id = u.user_id""")
def q_edit_users(spark, d):
    t = tables(spark, d)
    ed = t.raw("events").filter(F.col("event_type") == "error").select(
        "user_id", F.when(F.col("value") > 50, "admin").otherwise("").alias("role"), F.lit("").alias("department"),
        F.concat(F.lit("Edited "), F.col("event_id").cast("string")).alias("display_name"), F.col("event_id").alias("edit_seq"))
    return CH.edit_users(t.users, ed)


# Demo seed rows; DP-001 already exists and is skipped.
@register("seed_if_absent", """
SELECT product_ref, display_name FROM data_products
UNION ALL SELECT * FROM (VALUES ('DP-001', 'Budget Expenditure Report'), ('DP-9001', 'Budget Expenditure Report'),
  ('DP-9002', 'Payroll Dashboard')) v(product_ref, display_name)
 WHERE v.product_ref NOT IN (SELECT product_ref FROM data_products)""")
def q_seed_if_absent(spark, d):
    t = tables(spark, d)
    seeds = spark.createDataFrame(
        [("DP-001", "Budget Expenditure Report"), ("DP-9001", "Budget Expenditure Report"), ("DP-9002", "Payroll Dashboard")],
        "product_ref string, display_name string")
    return IO.seed_if_absent(t.data_products.select("product_ref", "display_name"), seeds, ["product_ref"])


# Outcome report for a deny batch that covers every low-priority request, whatever its state.
@register("decision_outcomes", """
SELECT DISTINCT d.request_id, r.status AS prior_status, 'deny' AS action,
 CASE WHEN r.status <> 'Pending' THEN 'was_' || lower(r.status) END AS note
FROM (SELECT DISTINCT request_id FROM access_requests WHERE business_reason = '5-LOW') d
JOIN access_requests r ON r.request_id = d.request_id""")
def q_decision_outcomes(spark, d):
    t = tables(spark, d)
    dec = t.access_requests.filter(F.col("business_reason") == "5-LOW").select("request_id")
    return CH.decision_outcomes(t.access_requests, dec, "deny")


# A batch of denials for the requesters whose key ends in 7, applied to the stored table bucketed by requester: only
# the parts that hold them are rewritten. The result is the whole table as it is read afterwards.
@register("stored_denials", f"""
SELECT request_id, product_id, requester_id, CASE WHEN hit THEN 'Denied' ELSE status END AS status,
 CASE WHEN hit THEN {AS_OF} ELSE resolved_at END AS resolved_at, CASE WHEN hit THEN 'stale' END AS denial_reason
FROM (SELECT *, status = 'Pending' AND requester_id % 10 = 7 AS hit FROM access_requests)""")
def q_stored_denials(spark, d):
    t = tables(spark, d)
    name = f"requests_{uuid.uuid4().hex[:12]}"
    stored = BucketedTable(spark, name, checkpoint_subdir(spark, name), ["requester_id"], parts=16)
    stored.create(CH._with_resolution_cols(t.access_requests))
    batch = t.access_requests.where("status = 'Pending' AND requester_id % 10 = 7").select(
        "requester_id", "request_id", F.lit(STEWARD_EMAIL).alias("approver_email"), F.lit("stale").alias("reason"))
    stored.change(batch, ["requester_id"], lambda old: CH.deny_requests(old, t.users, batch.drop("requester_id"), requests_as_of()))
    return stored.read().select("request_id", "product_id", "requester_id", "status", "resolved_at", "denial_reason")


# M1 batch with refusals: every turn of a conversation submits a product. Only users give it a name; every third turn
# has no description.
REGISTRATIONS_SQL = """sub AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Request ' || CAST(conv_id AS VARCHAR) ELSE ' ' END AS name,
  CASE WHEN turn % 3 <> 2 THEN text END AS description FROM conversations),
judged AS (SELECT conv_id, turn, array_to_string(list_filter([
   CASE WHEN NULLIF(trim(name), '') IS NULL THEN 'name is required' END,
   CASE WHEN NULLIF(trim(description), '') IS NULL THEN 'description is required' END], lambda x: x IS NOT NULL), '|') AS reasons FROM sub)"""


@register("refused_registrations", f"""WITH {REGISTRATIONS_SQL}
SELECT conv_id, turn, CASE WHEN reasons = '' THEN 'accepted' ELSE 'refused' END AS verdict, reasons FROM judged""")
def q_refused_registrations(spark, d):
    sub = tables(spark, d).conversations.select(
        "conv_id", "turn",
        F.when(F.col("role") == "user", F.concat(F.lit("Request "), F.col("conv_id").cast("string"))).otherwise(" ").alias("name"),
        F.when(F.col("turn") % 3 != 2, F.col("text")).alias("description"))
    path = checkpoint_subdir(spark, f"registrations_{uuid.uuid4().hex[:12]}")
    out = R.split(R.judge_registrations(sub), [R.NAME_MISSING, R.DESCRIPTION_MISSING], path)
    kept = out.accepted.select("conv_id", "turn", F.lit("accepted").alias("verdict"), F.lit("").alias("reasons"))
    return kept.unionByName(out.refused.select(
        "conv_id", "turn", F.lit("refused").alias("verdict"), F.array_join("reasons", "|").alias("reasons")))


# M5 batch with refusals: each event asks for product k. Purchases give no reason, events of every tenth user no e-mail,
# clicks use retired references that no product has, and errors name no product.
REQUESTS_SQL = """asked AS (SELECT event_id, event_type, user_id, regexp_extract(props, '[0-9]+', 0) AS k FROM events),
sub AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'OLD-' || k WHEN event_type <> 'error' AND k <> '' THEN 'DP-' || lpad(k, greatest(3, length(k))::int, '0') END AS product_ref,
  CASE WHEN user_id % 10 <> 9 THEN 'customer.' || CAST(user_id AS VARCHAR) || '@example.org' END AS requester_email,
  CASE WHEN event_type <> 'purchase' THEN event_type ELSE '' END AS reason FROM asked),
judged AS (SELECT s.event_id, p.product_id, array_to_string(list_filter([
   CASE WHEN s.product_ref IS NULL THEN 'productRef is required' END,
   CASE WHEN s.requester_email IS NULL THEN 'requesterEmail is required' END,
   CASE WHEN s.reason = '' THEN 'reason is required' END,
   CASE WHEN s.product_ref IS NOT NULL AND p.product_id IS NULL THEN 'product not found' END], lambda x: x IS NOT NULL), '|') AS reasons
 FROM sub s LEFT JOIN data_products p ON p.product_ref = s.product_ref)"""


def _asked(t):
    k = F.regexp_extract("props", "[0-9]+", 0)
    return t.raw("events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.concat(F.lit("OLD-"), k))
        .when((F.col("event_type") != "error") & (k != ""), _padded_ref(k)).alias("product_ref"),
        F.when(F.col("user_id") % 10 != 9, F.concat(F.lit("customer."), F.col("user_id").cast("string"), F.lit("@example.org"))).alias("requester_email"),
        F.when(F.col("event_type") != "purchase", F.col("event_type")).otherwise("").alias("reason"))


@register("refused_requests", f"""WITH {REQUESTS_SQL} SELECT event_id, product_id, reasons FROM judged WHERE reasons <> ''""")
def q_refused_requests(spark, d):
    t = tables(spark, d)
    return R.refused(R.judge_requests(_asked(t), t.data_products)).select("event_id", "product_id", "reasons")


@register("request_outcomes", f"""WITH {REQUESTS_SQL}
SELECT 'submitted' AS outcome, count(*) AS n_rows FROM judged UNION ALL
SELECT 'accepted', count(*) FROM judged WHERE reasons = '' UNION ALL SELECT 'refused', count(*) FROM judged WHERE reasons <> '' UNION ALL
SELECT r, count(*) FROM (SELECT unnest(string_split(reasons, '|')) AS r FROM judged WHERE reasons <> '') GROUP BY r""")
def q_request_outcomes(spark, d):
    t = tables(spark, d)
    path = checkpoint_subdir(spark, f"requests_{uuid.uuid4().hex[:12]}")
    reasons = [R.REF_MISSING, R.EMAIL_MISSING, R.REASON_MISSING, R.PRODUCT_UNKNOWN]
    out = R.split(R.judge_requests(_asked(t), t.data_products), reasons, path)
    verdicts = out.accepted.select(F.explode(F.array(F.lit("submitted"), F.lit("accepted"))).alias("outcome")).unionByName(
        out.refused.select(F.explode(F.concat(F.array(F.lit("submitted"), F.lit("refused")), "reasons")).alias("outcome")))
    return verdicts.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_rows"))


# M12 batch with refusals: all metadata tables are selected; those of products are registered already.
@register("refused_imports", """
SELECT catalog_name || '.' || schema_name || '.' || table_name AS full_name, 'already registered' AS reasons FROM meta_tables
WHERE lower(catalog_name || '.' || schema_name || '.' || table_name) IN
 (SELECT lower(uc_full_name) FROM data_products WHERE NULLIF(trim(uc_full_name), '') IS NOT NULL)""")
def q_refused_imports(spark, d):
    t = tables(spark, d)
    return R.refused(R.judge_imports(t.meta_tables.select(M.full_name().alias("full_name")), t.data_products))
