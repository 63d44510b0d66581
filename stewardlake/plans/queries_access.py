"""Registered access-request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import access as A
from ..operators import intervals as I
from ..operators.catalog import catalog_published
from ..sources.fixtures import tables
from .params import REQUESTS_AS_OF_TEXT, STEWARD_EMAIL, requests_as_of
from .registry import register

AS_OF = f"TIMESTAMP '{REQUESTS_AS_OF_TEXT}'"
ADMIN_ALIASES_SQL = "('admin','steward','data_steward','data steward')"

DETAIL_SQL = """
SELECT ar.request_id, ar.status, ar.business_reason, ar.requested_at, ar.resolved_at, ar.expires_at,
 dp.product_id, dp.product_ref, dp.display_name AS product_name, dp.domain, dp.type AS product_type,
 u.user_id AS requester_id, u.email AS requester_email, u.display_name AS requester_name, u.department AS requester_team
FROM access_requests ar JOIN data_products dp ON dp.product_id = ar.product_id
JOIN users u ON u.user_id = ar.requester_id"""

STATE_CTES = f"""
ranked AS (
 SELECT requester_id, product_id, request_id,
  CASE WHEN status = 'Approved' AND (expires_at IS NULL OR expires_at >= {AS_OF}) THEN 0
       WHEN status = 'Revoked' THEN 1 WHEN status = 'Pending' THEN 2 ELSE 9 END AS cls,
  COALESCE(resolved_at, requested_at) AS ts
 FROM access_requests),
best AS (
 SELECT *, row_number() OVER (PARTITION BY requester_id, product_id ORDER BY cls, ts DESC, request_id DESC) AS rn
 FROM ranked),
admins AS (SELECT user_id FROM users WHERE lower(trim(role)) IN {ADMIN_ALIASES_SQL}),
state AS (
 SELECT b.requester_id, b.product_id,
  CASE WHEN cls = 0 THEN 'granted' WHEN cls = 1 THEN 'revoked' WHEN cls = 2 THEN 'pending'
       WHEN a.user_id IS NOT NULL THEN 'admin' ELSE 'none' END AS state,
  CASE WHEN cls <= 2 THEN request_id END AS request_id,
  (cls = 0 OR (cls > 2 AND a.user_id IS NOT NULL)) AS can_query
 FROM best b LEFT JOIN admins a ON a.user_id = b.requester_id WHERE rn = 1)"""

PUBLISHED_WHERE = "is_active AND COALESCE(status, 'Published') = 'Published'"
DASH_TYPES_SQL = "(" + ", ".join(f"'{t}'" for t in rules.DASHBOARD_TYPES) + ")"


@register("requests_detail", DETAIL_SQL)
def q_requests_detail(spark, d):
    t = tables(spark, d)
    return A.requests_detail(t.access_requests, t.data_products, t.users)


@register("requests_filter", f"SELECT * FROM ({DETAIL_SQL}) x WHERE status = 'Approved'")
def q_requests_filter(spark, d):
    t = tables(spark, d)
    return A.requests_filter(A.requests_detail(t.access_requests, t.data_products, t.users), status="Approved")


@register("requests_pending", """
SELECT ar.request_id, ar.status, ar.business_reason, ar.requested_at, dp.product_ref, dp.display_name AS product_name,
 dp.domain, dp.uc_full_name, u.email AS requester_email, u.display_name AS requester_name, u.department AS requester_team
FROM access_requests ar JOIN data_products dp ON dp.product_id = ar.product_id
JOIN users u ON u.user_id = ar.requester_id WHERE ar.status = 'Pending'""")
def q_requests_pending(spark, d):
    t = tables(spark, d)
    return A.requests_pending(t.access_requests, t.data_products, t.users)


@register("granted_access", """
SELECT dp.product_ref, ar.request_id, ar.requested_at, ar.resolved_at, ar.expires_at,
 u.email AS requester_email, u.display_name AS requester_name
FROM access_requests ar JOIN data_products dp ON dp.product_id = ar.product_id
JOIN users u ON u.user_id = ar.requester_id WHERE ar.status = 'Approved'""")
def q_granted_access(spark, d):
    t = tables(spark, d)
    return A.granted_access(t.access_requests, t.data_products, t.users)


# Lookups: the ref of every Approved request, plus the raw id of every Denied
# one (not UUID-shaped, so it is looked up as a ref and finds nothing).
@register("requests_by_id_or_ref", """
WITH req AS (SELECT *, 'REQ-' || request_id AS request_ref FROM access_requests),
lookups AS (SELECT 'REQ-' || request_id AS id FROM access_requests WHERE status = 'Approved'
            UNION ALL SELECT request_id AS id FROM access_requests WHERE status = 'Denied')
SELECT l.id, r.request_id, r.request_ref, r.status, r.product_id, r.requester_id
FROM lookups l JOIN req r ON (CASE WHEN regexp_matches(l.id, '^[0-9a-fA-F-]{36}$') THEN r.request_id ELSE r.request_ref END) = l.id""")
def q_requests_by_id_or_ref(spark, d):
    t = tables(spark, d)
    req = t.access_requests.withColumn("request_ref", F.concat(F.lit("REQ-"), "request_id"))
    lookups = (
        req.filter(F.col("status") == "Approved").select(F.col("request_ref").alias("id"))
        .unionByName(req.filter(F.col("status") == "Denied").select(F.col("request_id").alias("id")))
    )
    return A.requests_by_id_or_ref(req, lookups)


@register("access_state", f"WITH {STATE_CTES} SELECT requester_id, product_id, state, request_id, can_query FROM state")
def q_access_state(spark, d):
    t = tables(spark, d)
    return A.access_state(t.access_requests, t.users, requests_as_of())


@register("can_query", f"WITH {STATE_CTES} SELECT requester_id, product_id, state FROM state WHERE can_query")
def q_can_query(spark, d):
    t = tables(spark, d)
    return A.can_query(A.access_state(t.access_requests, t.users, requests_as_of()))


@register("approved_access", f"""
SELECT DISTINCT requester_id, product_id FROM access_requests
WHERE status = 'Approved' AND (expires_at IS NULL OR expires_at >= {AS_OF})""")
def q_approved_access(spark, d):
    t = tables(spark, d)
    return A.approved_access(t.access_requests, requests_as_of())


@register("user_library", """
SELECT x.user_id, x.product_id, x.source, x.added_at, x.request_id, dp.product_ref, dp.display_name AS product_name,
 dp.domain, dp.type AS product_type, dp.refresh_frequency, dp.source_system, dp.uc_full_name
FROM (SELECT requester_id AS user_id, product_id, 'approved' AS source, resolved_at AS added_at, request_id
      FROM access_requests WHERE status = 'Approved'
      UNION ALL
      SELECT user_id, product_id, 'library' AS source, CAST(NULL AS TIMESTAMP) AS added_at, CAST(NULL AS VARCHAR) AS request_id
      FROM user_library) x
JOIN data_products dp ON dp.product_id = x.product_id
WHERE x.user_id IN (SELECT user_id FROM users)""")
def q_user_library(spark, d):
    t = tables(spark, d)
    return A.user_library(t.access_requests, t.user_library, t.data_products, t.users)


@register("notifications", f"""
WITH exp AS (
 SELECT requester_id, 'Expiring' AS kind, row_number() OVER (PARTITION BY requester_id ORDER BY expires_at, request_id) AS rank,
  request_id, resolved_at, expires_at, product_id
 FROM access_requests WHERE status = 'Approved' AND expires_at < {AS_OF} + INTERVAL '14' DAY),
rec AS (
 SELECT requester_id, status AS kind, row_number() OVER (PARTITION BY requester_id ORDER BY resolved_at DESC, request_id) AS rank,
  request_id, resolved_at, expires_at, product_id
 FROM access_requests WHERE status IN ('Approved','Denied','Revoked') AND resolved_at > {AS_OF} - INTERVAL '7' DAY)
SELECT n.requester_id, n.kind, n.rank, n.request_id, n.resolved_at, n.expires_at, dp.product_ref, dp.display_name AS product_name
FROM (SELECT * FROM exp WHERE rank <= 5 UNION ALL SELECT * FROM rec WHERE rank <= 10) n
JOIN data_products dp ON dp.product_id = n.product_id""")
def q_notifications(spark, d):
    t = tables(spark, d)
    return A.notifications(t.access_requests, t.data_products, requests_as_of())


@register("recently_accessed", """
SELECT r.requester_id, r.rank, r.request_id, r.resolved_at, dp.product_ref, dp.display_name AS product_name,
 COALESCE(dp.type, 'Dataset') AS product_type
FROM (SELECT *, row_number() OVER (PARTITION BY requester_id ORDER BY resolved_at DESC, request_id) AS rank
      FROM access_requests WHERE status = 'Approved') r
JOIN data_products dp ON dp.product_id = r.product_id WHERE r.rank <= 4""")
def q_recently_accessed(spark, d):
    t = tables(spark, d)
    return A.recently_accessed(t.access_requests, t.data_products, 4)


@register("request_status_counts", """
SELECT count(*) FILTER (WHERE status = 'Pending') AS pending, count(*) FILTER (WHERE status = 'Approved') AS approved,
 count(*) FILTER (WHERE status = 'Denied') AS denied FROM access_requests""")
def q_request_status_counts(spark, d):
    return A.request_status_counts(tables(spark, d).access_requests)


@register("my_status_counts", """
SELECT requester_id, count(*) FILTER (WHERE status = 'Pending') AS pending, count(*) FILTER (WHERE status = 'Approved') AS approved,
 count(*) FILTER (WHERE status = 'Denied') AS denied FROM access_requests GROUP BY requester_id""")
def q_my_status_counts(spark, d):
    return A.my_status_counts(tables(spark, d).access_requests)


@register("insight_stats", f"""
WITH {STATE_CTES},
pub AS (SELECT product_id, type FROM data_products WHERE {PUBLISHED_WHERE}),
st AS (SELECT requester_id, count(*) FILTER (WHERE state = 'granted') AS n_granted,
        count(*) FILTER (WHERE state IN ('revoked','pending')) AS n_blocked
       FROM state WHERE product_id IN (SELECT product_id FROM pub) GROUP BY requester_id),
k AS (SELECT count(*) AS n_pub, count(*) FILTER (WHERE type IN {DASH_TYPES_SQL}) AS n_dash FROM pub),
acc AS (
 SELECT u.user_id, CASE WHEN lower(trim(u.role)) IN {ADMIN_ALIASES_SQL} THEN k.n_pub - COALESCE(st.n_blocked, 0)
        ELSE COALESCE(st.n_granted, 0) END AS accessible, k.n_pub, k.n_dash
 FROM users u CROSS JOIN k LEFT JOIN st ON st.requester_id = u.user_id)
SELECT user_id, accessible, n_pub - accessible AS requestable, n_dash AS dashboards, n_pub - n_dash AS other_products FROM acc""")
def q_insight_stats(spark, d):
    t = tables(spark, d)
    published = catalog_published(t.data_products)
    # Only published products count: drop the other requests before the per-pair aggregate.
    reqs = t.access_requests.join(published.select("product_id"), "product_id", "left_semi")
    state = A.access_state(reqs, t.users, requests_as_of())
    return A.insight_stats(state, published, t.users)


# One user's view (the page is per persona); user 1 has role 'Admin'.
@register("accessible_vs_restricted", f"""
WITH {STATE_CTES}
SELECT p.product_id, p.product_ref, p.display_name, COALESCE(s.state, 'admin') AS state,
 COALESCE(s.state, 'admin') IN ('granted','admin') AS accessible
FROM (SELECT * FROM data_products WHERE {PUBLISHED_WHERE}) p
LEFT JOIN (SELECT * FROM state WHERE requester_id = 1) s ON s.product_id = p.product_id""")
def q_accessible_vs_restricted(spark, d):
    t = tables(spark, d)
    state = A.access_state(t.access_requests, t.users, requests_as_of())
    return A.accessible_vs_restricted(state, catalog_published(t.data_products), user_id=1, is_admin=True)


DECISIONS_SQL = f"""
SELECT ar.request_id, CASE WHEN u.department = 'BUILDING' THEN upper(u.email) ELSE '{STEWARD_EMAIL}' END AS approver_email
FROM access_requests ar JOIN users u ON u.user_id = ar.requester_id"""


@register("approvable", f"""
WITH decisions AS ({DECISIONS_SQL})
SELECT d.request_id, d.approver_email, r.status,
 CASE WHEN lower(u.email) = lower(d.approver_email) THEN 'self_approval'
      WHEN r.status IS NOT NULL AND r.status <> 'Pending' THEN 'already_' || lower(r.status) END AS reason,
 NOT COALESCE(lower(u.email) = lower(d.approver_email), FALSE) AND NOT (r.status IS NOT NULL AND r.status <> 'Pending') AS approvable
FROM decisions d JOIN access_requests r ON r.request_id = d.request_id LEFT JOIN users u ON u.user_id = r.requester_id""")
def q_approvable(spark, d):
    t = tables(spark, d)
    dec = A.decision_batch(t.access_requests, t.users, STEWARD_EMAIL)
    return A.approvable(dec, t.access_requests, t.users)


# Submitted batch: every pinned library item is "submitted" as a request.
@register("open_request_check", """
SELECT l.user_id, l.product_id, EXISTS (SELECT 1 FROM access_requests r WHERE r.requester_id = l.user_id AND r.product_id = l.product_id) AS has_request
FROM user_library l""")
def q_open_request_check(spark, d):
    t = tables(spark, d)
    return A.open_request_check(t.user_library, t.access_requests)


# The access log has no product and time of a call, so calls are the deliveries: the customer of an order uses the
# product of each line on the day it was shipped, and again 200 days later.
CALLS = """calls AS (
 SELECT o_custkey AS user_id, l_partkey AS product_id, l_orderkey * 10 + l_linenumber AS call_id, n.i AS nth,
  CAST(l_shipdate AS TIMESTAMP) + n.i * INTERVAL '200' DAY AS called_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (VALUES (0), (1)) n(i))"""
INTERVALS = """granted AS (
 SELECT requester_id, product_id, COALESCE(resolved_at, requested_at) AS a, COALESCE(expires_at, TIMESTAMP '9999-12-31 00:00:00') AS b
 FROM access_requests WHERE status = 'Approved'),
starts AS (
 SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY requester_id, product_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 0 ELSE 1 END AS first FROM granted WHERE a < b),
islands AS (
 SELECT *, sum(first) OVER (PARTITION BY requester_id, product_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM starts),
intervals AS (
 SELECT requester_id, product_id, min(a) AS from_at, max(b) AS to_at, count(*) AS n_grants FROM islands
 GROUP BY requester_id, product_id, island)"""


def _calls(t):
    lines = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"),
                        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"),
                        F.col("l_shipdate").cast("timestamp_ntz").alias("day"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth")).select(
        "user_id", "product_id", "call_id", "nth", (F.col("day") + F.make_dt_interval(days=200 * F.col("nth"))).alias("called_at"))


@register("access_intervals", f"WITH {INTERVALS} SELECT * FROM intervals")
def q_access_intervals(spark, d):
    return I.access_intervals(tables(spark, d).access_requests)


@register("calls_without_access", f"""WITH {CALLS}, {INTERVALS}
SELECT user_id, c.product_id, call_id, nth, called_at FROM calls c WHERE NOT EXISTS (
 SELECT 1 FROM intervals i WHERE i.requester_id = c.user_id AND i.product_id = c.product_id AND called_at >= from_at AND called_at < to_at)""")
def q_calls_without_access(spark, d):
    t = tables(spark, d)
    return I.calls_without_access(_calls(t), I.access_intervals(t.access_requests))
