"""Registered governance and demand queries
(G1, G2, J10, J13, L3, M9, F2, F5, F6, F10, F11, F13, F19, J4, A4, P18, L4, A8, A16-A18, M15, M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import normalize_role
from ..functions.grants import audit_metadata, grant_sql, revoke_sql
from ..functions.sampling import stable_unit_sql
from ..functions.text import name_from_email
from ..operators import access as A
from ..operators import demand as D
from ..operators import governance as G
from ..operators import metadata as M
from ..sources.fixtures import tables
from .params import REQUESTS_AS_OF_TEXT, requests_as_of
from .queries_access import STATE_CTES
from .queries_metadata import CLASSIFIED, ELEV_RE, PII_RE, word_caps_sql
from .registry import register

AS_OF = f"TIMESTAMP '{REQUESTS_AS_OF_TEXT}'"


@register("masked", f"""WITH {CLASSIFIED}
SELECT product_id, column_name, sensitivity IN ('PII','CONFIDENTIAL') AS masked,
 sensitivity = 'PII' AND regexp_matches(column_name, '{PII_RE}') AND regexp_matches(column_name, '{ELEV_RE}') AS elevated_pii
FROM classified""")
def q_masked(spark, d):
    t = tables(spark, d)
    return M.classify_columns(M.columns_with_tags(t.meta_columns, t.meta_column_tags)).select(
        "product_id", "column_name", "masked", "elevated_pii")


# Viewer without access: PII and confidential columns are masked.
@register("mask_table", """
SELECT customer_id, CASE WHEN ssn_last4 IS NOT NULL THEN '****' END AS ssn_last4,
 CASE WHEN email_address IS NOT NULL THEN '****' END AS email_address,
 CASE WHEN budget_code IS NOT NULL THEN '****' END AS budget_code, amount, CAST(NULL AS DATE) AS birth_date, region
FROM customer_profile""")
def q_mask_table(spark, d):
    prof = tables(spark, d).customer_profile
    return G.mask_table(prof, G.column_classes(prof), access="none")


# Viewer with a standard approval: only elevated PII stays masked.
@register("mask_table_standard", """
SELECT customer_id, CASE WHEN ssn_last4 IS NOT NULL THEN '****' END AS ssn_last4, email_address, budget_code, amount,
 CAST(NULL AS DATE) AS birth_date, region FROM customer_profile""")
def q_mask_table_standard(spark, d):
    prof = tables(spark, d).customer_profile
    return G.mask_table(prof, G.column_classes(prof), access="standard")


# Product = the smallest product id with a live (approved, unexpired) grant; its data are its line items.
@register("gated_preview", f"""WITH {STATE_CTES},
pid AS (SELECT min(product_id) AS p FROM access_requests WHERE status = 'Approved' AND (expires_at IS NULL OR expires_at >= {AS_OF})),
preview AS (SELECT * FROM lineitem WHERE l_partkey = (SELECT p FROM pid)
            ORDER BY l_orderkey, l_linenumber, l_suppkey LIMIT 5)
SELECT s.requester_id AS viewer_id, preview.* FROM state s, preview
WHERE s.can_query AND s.product_id = (SELECT p FROM pid)""")
def q_gated_preview(spark, d):
    t = tables(spark, d)
    state = A.access_state(t.access_requests, t.users, requests_as_of())
    pid = A.approved_access(t.access_requests, requests_as_of()).select(F.min("product_id")).scalar()
    rows = t.raw("lineitem").filter(F.col("l_partkey") == pid)
    return G.gated_preview(state, pid, rows, ["l_orderkey", "l_linenumber", "l_suppkey"])


# G2 over a table with sensitive columns: the data of a product are the profiles of the customers who asked for it;
# granted viewers do not see elevated PII, admins see everything.
@register("gated_previews_masked", f"""WITH {STATE_CTES},
data AS (SELECT DISTINCT ar.product_id, p.* FROM access_requests ar JOIN customer_profile p ON p.customer_id = ar.requester_id),
prev AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY customer_id) AS rank FROM data)
SELECT s.requester_id AS viewer_id, p.product_id, p.customer_id, CASE WHEN s.state = 'admin' OR p.ssn_last4 IS NULL THEN p.ssn_last4 ELSE '****' END AS ssn_last4,
 p.email_address, p.budget_code, p.amount, CASE WHEN s.state = 'admin' THEN p.birth_date END AS birth_date, p.region, p.rank
FROM state s JOIN prev p ON p.product_id = s.product_id WHERE s.can_query AND p.rank <= 5""")
def q_gated_previews_masked(spark, d):
    t = tables(spark, d)
    state = A.access_state(t.access_requests, t.users, requests_as_of())
    asked = t.access_requests.select("product_id", F.col("requester_id").alias("customer_id")).distinct()
    rows = asked.join(t.customer_profile, "customer_id")
    return G.gated_previews(state, rows, "product_id", ["customer_id"], 5)


# G2 for all products: every viewer's first 5 line items of each product they may query.
@register("gated_previews", f"""WITH {STATE_CTES},
prev AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rank
 FROM lineitem)
SELECT s.requester_id AS viewer_id, p.* FROM state s JOIN prev p ON p.l_partkey = s.product_id
WHERE s.can_query AND p.rank <= 5""")
def q_gated_previews(spark, d):
    t = tables(spark, d)
    state = A.access_state(t.access_requests, t.users, requests_as_of())
    rows = t.raw("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    return G.gated_previews(state, rows, "l_partkey",
                            ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"], 5)


@register("user_group_role", """
SELECT user_id, group_name, role AS group_role FROM (
 SELECT u.user_id, g.group_name, g.role, row_number() OVER (PARTITION BY u.user_id ORDER BY
   CASE WHEN lower(g.role) = 'admin' THEN 0 WHEN lower(g.role) = 'steward' THEN 1 ELSE 2 END, g.group_name, g.role) AS rn
 FROM users u JOIN portal_groups g ON g.group_name = u.department) WHERE rn = 1""")
def q_user_group_role(spark, d):
    t = tables(spark, d)
    return G.user_group_role(t.users, t.portal_groups)


# FIXED VALUES, stated here once more so that the oracle does not share the library's rule table: the first rule that
# fits decides ('*' is any method), and a path that fits none needs an admin.
POLICY_SQL = r"""policy(i, m, p, l) AS (VALUES
 (0, 'GET', '^/api/health$', 'public'),
 (1, 'GET', '^/api/portal/config$', 'public'),
 (2, 'GET', '^/api/portal/identity$', 'public'),
 (3, '*', '^/api/portal/admin/', 'admin'),
 (4, 'PUT', '^/api/portal/settings$', 'admin'),
 (5, 'GET', '^/api/portal/audit$', 'admin'),
 (6, 'GET', '^/api/portal/requests/pending$', 'admin'),
 (7, 'PUT', '^/api/portal/requests/[^/]+/(approve|deny|revoke)$', 'admin'),
 (8, 'GET', '^/api/portal/products/pending$', 'admin'),
 (9, 'GET', '^/api/portal/products/debug$', 'admin'),
 (10, 'PUT', '^/api/portal/products/[^/]+/(publish|reject)$', 'admin'),
 (11, 'PUT', '^/api/portal/products/[^/]+$', 'admin'),
 (12, 'DELETE', '^/api/portal/products/[^/]+$', 'admin'),
 (13, 'PUT', '^/api/portal/feature-requests/[^/]+/status$', 'admin'),
 (14, 'POST', '^/api/portal/demo-(seed|reset)$', 'admin'),
 (15, 'GET', '^/api/portal/products$', 'user'),
 (16, 'POST', '^/api/portal/products$', 'user'),
 (17, 'GET', '^/api/portal/products/[^/]+/(schema|preview|granted-access)$', 'user'),
 (18, 'GET', '^/api/portal/requests$', 'user'),
 (19, 'POST', '^/api/portal/requests$', 'user'),
 (20, 'POST', '^/api/portal/requests/[^/]+/nudge$', 'user'),
 (21, 'GET', '^/api/portal/notifications$', 'user'),
 (22, 'GET', '^/api/portal/library$', 'user'),
 (23, 'GET', '^/api/portal/settings$', 'user'),
 (24, 'GET', '^/api/kpis$', 'user'),
 (25, 'POST', '^/api/portal/ask-catalog$', 'user'),
 (26, 'GET', '^/api/portal/feature-requests$', 'user'),
 (27, 'POST', '^/api/portal/feature-requests$', 'user'),
 (28, 'POST', '^/api/portal/feature-requests/[^/]+/vote$', 'user'))"""


@register("policy_audit", f"""WITH {POLICY_SQL},
fits AS (SELECT log_id, min(i) AS i FROM access_log, policy
 WHERE (m = '*' OR m = method) AND regexp_matches(path, p) GROUP BY log_id)
SELECT a.log_id, a.method, a.path, a.user_id, COALESCE(policy.l, 'admin') AS level, CAST(fits.i AS INTEGER) AS rule_index
FROM access_log a LEFT JOIN fits USING (log_id) LEFT JOIN policy ON policy.i = fits.i""")
def q_policy_audit(spark, d):
    return G.policy_audit(tables(spark, d).access_log)


@register("audit_recent", "SELECT * FROM audit_log ORDER BY occurred_at DESC, log_id DESC LIMIT 50")
def q_audit_recent(spark, d):
    return G.audit_recent(tables(spark, d).audit_log, 50)


NUDGE_META = "'{\"request_id\":\"' || request_id || '\",\"message\":\"Requester sent a reminder to approver\"}'"


@register("audit_append", f"""
WITH ev AS (
 SELECT DISTINCT 'NUDGE_SENT' AS event_type, requester_id AS actor_id, {NUDGE_META} AS metadata, {AS_OF} AS occurred_at
 FROM access_requests WHERE status = 'Pending' AND requested_at < {AS_OF} - INTERVAL '30' DAY
  AND requester_id IN (SELECT user_id FROM users)),
fresh AS (SELECT * FROM ev WHERE (event_type, actor_id, metadata, occurred_at) NOT IN (SELECT event_type, actor_id, metadata, occurred_at FROM audit_log))
SELECT log_id, event_type, actor_id, metadata, occurred_at FROM audit_log
UNION ALL
SELECT (SELECT COALESCE(max(log_id), 0) FROM audit_log) + row_number() OVER (ORDER BY CAST(occurred_at AS VARCHAR) || '|' || metadata),
 event_type, actor_id, metadata, occurred_at FROM fresh""")
def q_audit_append(spark, d):
    t = tables(spark, d)
    ev = G.nudge_events(t.access_requests, t.users, requests_as_of())
    return G.audit_append(t.audit_log, ev.unionByName(ev))  # a batch that was delivered twice


@register("name_from_email", f"""SELECT user_id, email,
 {word_caps_sql("translate(split_part(email, '@', 1), '._', '  ')")} AS name FROM users""")
def q_name_from_email(spark, d):
    u = tables(spark, d).users
    return u.select("user_id", "email", name_from_email("email").alias("name"))


@register("normalize_role", """SELECT user_id, role,
 CASE WHEN lower(trim(role)) IN ('admin','steward','data_steward','data steward') THEN 'admin' ELSE 'analyst' END AS normalized_role FROM users""")
def q_normalize_role(spark, d):
    u = tables(spark, d).users
    return u.select("user_id", "role", normalize_role("role").alias("normalized_role"))


def _grant_sql_sql(full, email, name):
    quoted = f"array_to_string(list_transform(string_split({full}, '.'), lambda p: '`' || replace(p, '`', '``') || '`'), '.')"
    head, tail = rules.NO_TABLE_GRANT_COMMENT.split("{name}")
    return (f"CASE WHEN {full} IS NULL OR {full} = '' THEN '{head}' || COALESCE({name}, '') || '{tail}' "
            f"ELSE 'GRANT SELECT ON ' || {quoted} || ' TO `' || replace({email}, '`', '``') || '`;' END")


GRANTS = f"""g AS (
 SELECT ar.request_id, {_grant_sql_sql('dp.uc_full_name', 'u.email', 'dp.display_name')} AS grant_sql
 FROM access_requests ar JOIN data_products dp ON dp.product_id = ar.product_id JOIN users u ON u.user_id = ar.requester_id
 WHERE ar.status = 'Approved')"""


def _grants_frame(t):
    det = A.requests_detail(t.access_requests, t.data_products, t.users).filter(F.col("status") == "Approved")
    full = t.data_products.select("product_id", "uc_full_name")
    return det.join(full, "product_id", "inner").select(
        "request_id", grant_sql("uc_full_name", "requester_email", "product_name").alias("grant_sql"))


@register("grant_sql", f"WITH {GRANTS} SELECT * FROM g")
def q_grant_sql(spark, d):
    return _grants_frame(tables(spark, d))


@register("revoke_sql", f"""WITH {GRANTS}
SELECT request_id, CASE WHEN grant_sql IS NULL OR grant_sql = '' THEN '{rules.NO_TABLE_REVOKE_COMMENT}'
 ELSE regexp_replace(regexp_replace(grant_sql, '^GRANT', 'REVOKE'), '^(.*?) TO ', '\\1 FROM ') END AS revoke_sql FROM g""")
def q_revoke_sql(spark, d):
    g = _grants_frame(tables(spark, d))
    return g.select("request_id", revoke_sql("grant_sql").alias("revoke_sql"))


@register("audit_metadata", """
SELECT ar.request_id,
 '{"productRef":"' || dp.product_ref || '","reason":"' || ar.business_reason || '"}' AS metadata,
 dp.product_ref AS product_ref_back
FROM access_requests ar JOIN data_products dp ON dp.product_id = ar.product_id""")
def q_audit_metadata(spark, d):
    t = tables(spark, d)
    j = t.access_requests.join(t.data_products.select("product_id", "product_ref"), "product_id", "inner")
    meta = audit_metadata(productRef=F.col("product_ref"), reason=F.col("business_reason"))
    return j.select("request_id", meta.alias("metadata")).withColumn(
        "product_ref_back", F.get_json_object("metadata", "$.productRef"))


@register("backfill_last_refreshed", f"""
SELECT product_id, refresh_frequency,
 CASE WHEN last_refreshed IS NULL AND refresh_frequency IS NOT NULL THEN
  {AS_OF} - CAST(floor({stable_unit_sql('product_id', 0, 0)} *
   CASE refresh_frequency WHEN 'Daily' THEN 1 WHEN 'Weekly' THEN 7 WHEN 'Monthly' THEN 30 ELSE 365 END * 86400) AS BIGINT)
   * INTERVAL '1' SECOND
 ELSE last_refreshed END AS last_refreshed
FROM data_products""")
def q_backfill_last_refreshed(spark, d):
    p = tables(spark, d).data_products
    return G.backfill_last_refreshed(p, requests_as_of()).select("product_id", "refresh_frequency", "last_refreshed")


# ---- feature requests -------------------------------------------------------------------
FR = """fr AS (
 SELECT request_id, trim(title) AS title,
  CASE status_src WHEN 'en' THEN 'open' WHEN 'de' THEN 'on_roadmap' WHEN 'fr' THEN 'done' WHEN 'es' THEN 'declined' ELSE 'open' END AS status,
  requester AS requester_email FROM feature_requests)"""
VIEWER_EMAIL, VIEWER_ID = "src3", 3
WITH_VOTES = f"""{FR},
wv AS (
 SELECT fr.request_id, fr.title, fr.status, fr.requester_email, COALESCE(v.upvotes, 0) AS upvotes,
  (fr.requester_email = '{VIEWER_EMAIL}' OR COALESCE(v.viewer_voted, FALSE)) AS user_voted
 FROM fr LEFT JOIN (SELECT request_id, count(*) AS upvotes, bool_or(voter_id = {VIEWER_ID}) AS viewer_voted
                    FROM feature_request_votes GROUP BY request_id) v ON v.request_id = fr.request_id)"""


def _with_votes(t):
    return D.votes_left_join(D.feature_requests_model(t.feature_requests), t.feature_request_votes, VIEWER_EMAIL, VIEWER_ID)


@register("votes_left_join", f"WITH {WITH_VOTES} SELECT * FROM wv")
def q_votes_left_join(spark, d):
    return _with_votes(tables(spark, d))


@register("voters_by_request", """
SELECT v.request_id, u.email AS voter_email, count(*) OVER (PARTITION BY v.request_id) AS n_voters
FROM (SELECT DISTINCT request_id, voter_id FROM feature_request_votes) v JOIN users u ON u.user_id = v.voter_id""")
def q_voters_by_request(spark, d):
    t = tables(spark, d)
    return D.voters_by_request(t.feature_request_votes, t.users)


@register("feature_tabs", f"""WITH {WITH_VOTES}
SELECT tab, request_id, title, status FROM (
 SELECT 'All' AS tab, * FROM wv WHERE status <> 'declined'
 UNION ALL SELECT 'On Roadmap', * FROM wv WHERE status = 'on_roadmap'
 UNION ALL SELECT 'My Requests', * FROM wv WHERE user_voted
 UNION ALL SELECT 'Done', * FROM wv WHERE status = 'done') WHERE contains(lower(title), 'the')""")
def q_feature_tabs(spark, d):
    return D.feature_tabs(_with_votes(tables(spark, d)), search="the")


@register("feature_ranking", f"WITH {WITH_VOTES} SELECT * FROM wv")
def q_feature_ranking(spark, d):
    return D.feature_ranking(_with_votes(tables(spark, d)))


# Toggle batch: every click is a vote toggle of (request k, user).
@register("toggle_votes", """
WITH par AS (SELECT request_id, voter_id FROM (
  SELECT CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS request_id, user_id AS voter_id FROM events WHERE event_type = 'click')
  GROUP BY 1, 2 HAVING count(*) % 2 = 1),
cur AS (SELECT DISTINCT request_id, voter_id FROM feature_request_votes),
nv AS (SELECT * FROM cur WHERE (request_id, voter_id) NOT IN (SELECT request_id, voter_id FROM par)
       UNION ALL SELECT * FROM par WHERE (request_id, voter_id) NOT IN (SELECT request_id, voter_id FROM cur))
SELECT fr.request_id, greatest(COALESCE(c.n, 0), 0) AS upvotes FROM feature_requests fr
LEFT JOIN (SELECT request_id, count(*) AS n FROM nv GROUP BY 1) c ON c.request_id = fr.request_id""")
def q_toggle_votes(spark, d):
    t = tables(spark, d)
    toggles = t.raw("events").filter(F.col("event_type") == "click").select(
        F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("request_id"), F.col("user_id").alias("voter_id"))
    return D.toggle_votes(t.feature_request_votes, toggles, t.feature_requests)["upvotes"]


# Submissions: the user turns of conversations (whole text as the title).
@register("submit_features", f"""WITH {FR},
sub AS (SELECT (conv_id, turn) AS submission_id, trim(text) AS title, 'user' || CAST(conv_id AS VARCHAR) || '@example.org' AS requester_email
        FROM conversations WHERE role = 'user'),
ok AS (SELECT * FROM sub WHERE title IS NOT NULL AND title <> '')
SELECT request_id, title, status, requester_email FROM fr
UNION ALL
SELECT (SELECT COALESCE(max(request_id), 0) FROM fr) + row_number() OVER (ORDER BY submission_id), title, 'open', requester_email FROM ok""")
def q_submit_features(spark, d):
    t = tables(spark, d)
    sub = t.conversations.filter(F.col("role") == "user").select(
        F.format_string("%020d-%020d", "conv_id", "turn").alias("submission_id"), F.col("text").alias("title"),
        F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.org")).alias("requester_email"),
        F.col("conv_id").alias("submitter_id"))
    return D.submit_features(D.feature_requests_model(t.feature_requests), sub)["feature_requests"]


# Two status changes of each label, the first (open) sorting last: quality -> done, toxic -> declined, else an invalid status (ignored).
@register("set_feature_status", f"""WITH {FR},
ch AS (SELECT doc_id AS request_id, CASE WHEN toxic = 1 THEN 'declined' WHEN quality = 1 THEN 'done' ELSE 'bogus' END AS status FROM labels),
ok AS (SELECT * FROM ch WHERE status IN ('open','on_roadmap','done','declined'))
SELECT fr.request_id, fr.title, COALESCE(ok.status, fr.status) AS status, fr.requester_email
FROM fr LEFT JOIN ok ON ok.request_id = fr.request_id""")
def q_set_feature_status(spark, d):
    t = tables(spark, d)
    ch = t.raw("labels").select(
        F.col("doc_id").alias("request_id"),
        F.when(F.col("toxic") == 1, "declined").when(F.col("quality") == 1, "done").otherwise("bogus").alias("status"),
        F.lit(2).alias("changed_seq"))
    first = ch.filter(F.col("status") != "bogus").select("request_id", F.lit("open").alias("status"), F.lit(1).alias("changed_seq"))
    ch = ch.unionByName(first)
    return D.set_feature_status(D.feature_requests_model(t.feature_requests), ch)


# ---- spend and finance --------------------------------------------------------------------
# FIXED VALUES, stated here once more so that the oracle does not share the library's rule tables.
@register("spend_by_resource", """
SELECT usage_date, usage_type,
 CASE WHEN tag_app = 'portal' THEN 'Warehouse' WHEN sku_name LIKE '%LAKEBASE%' THEN 'Lakebase (Postgres)'
      WHEN sku_name LIKE '%FOUNDATION_MODEL%' OR sku_name LIKE '%LLAMA%' OR sku_name LIKE '%PREMIUM_SERVING%' THEN 'Ask AI (FMAPI)'
      ELSE 'Other' END AS resource,
 round(sum(usage_quantity), 4) AS dbus
FROM billing_usage WHERE COALESCE(tag_app = 'portal' OR sku_name LIKE '%LAKEBASE%' OR sku_name LIKE '%FOUNDATION_MODEL%'
 OR sku_name LIKE '%PREMIUM_SERVING%', FALSE)
GROUP BY 1, 2, 3""")
def q_spend_by_resource(spark, d):
    return D.spend_by_resource(tables(spark, d).billing_usage, "portal")


@register("budget_variance", """
WITH net AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS actual FROM lineitem GROUP BY 1),
agg AS (SELECT c.c_mktsegment AS department, sum(o.o_totalprice) AS budgeted, sum(COALESCE(n.actual, 0)) AS actual
        FROM orders o LEFT JOIN net n ON n.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1)
SELECT department, round(budgeted, 2) AS budgeted, round(actual, 2) AS actual, round(budgeted - actual, 2) AS variance
FROM agg ORDER BY budgeted DESC, department LIMIT 5""")
def q_budget_variance(spark, d):
    t = tables(spark, d)
    return D.budget_variance(t.raw("lineitem"), t.raw("orders"), t.raw("customer"))


@register("vendor_flags", """
WITH per AS (
 SELECT s.s_suppkey, s.s_name, COALESCE(p.paid, 0) AS paid, COALESCE(p.n_lines, 0) AS n_lines FROM supplier s LEFT JOIN (
  SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS paid, count(*) AS n_lines FROM lineitem GROUP BY 1) p
 ON p.l_suppkey = s.s_suppkey),
st AS (SELECT avg(paid) AS m, stddev_samp(paid) AS sd FROM per)
SELECT s_suppkey, s_name, round(paid, 2) AS paid, n_lines,
 CASE WHEN paid > m + 2 * COALESCE(sd, 0) THEN 'review' WHEN n_lines < 10 THEN 'low_activity' ELSE 'ok' END AS flag
FROM per, st""")
def q_vendor_flags(spark, d):
    t = tables(spark, d)
    return D.vendor_flags(t.raw("lineitem"), t.raw("supplier"))


@register("billing_outliers", """
WITH daily AS (SELECT usage_type, usage_date, sum(usage_quantity) AS qty FROM billing_usage GROUP BY 1, 2),
sc AS (SELECT *, (qty - avg(qty) OVER (PARTITION BY usage_type)) / stddev_samp(qty) OVER (PARTITION BY usage_type) AS z FROM daily)
SELECT usage_type, usage_date, round(qty, 4) AS qty, round(z, 4) AS z_score FROM sc WHERE abs(z) > 2.0""")
def q_billing_outliers(spark, d):
    return D.billing_outliers(tables(spark, d).billing_usage, 2.0)


# A17 and A18 with median and median deviation (exact medians).
@register("vendor_flags_robust", """
WITH per AS (
 SELECT s.s_suppkey, s.s_name, round(COALESCE(p.paid, 0), 2) AS paid, COALESCE(p.n_lines, 0) AS n_lines FROM supplier s LEFT JOIN (
  SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS paid, count(*) AS n_lines FROM lineitem GROUP BY 1) p
 ON p.l_suppkey = s.s_suppkey),
md AS (SELECT median(paid) AS md FROM per),
mad AS (SELECT median(abs(paid - md)) AS mad FROM per, md),
z AS (SELECT per.*, CASE WHEN paid = md THEN 0.0 ELSE COALESCE((paid - md) / NULLIF(1.4826 * mad, 0), CASE WHEN paid > md THEN 'inf' ELSE '-inf' END::double) END AS z
 FROM per, md, mad)
SELECT s_suppkey, s_name, paid, n_lines, round(z, 4) AS robust_z,
 CASE WHEN z > 3.5 THEN 'review' WHEN n_lines < 10 THEN 'low_activity' ELSE 'ok' END AS flag FROM z""")
def q_vendor_flags_robust(spark, d):
    t = tables(spark, d)
    return D.vendor_flags_robust(t.raw("lineitem"), t.raw("supplier"))


# All days that are over 1.5 deviations away, so that the ordinary fixture has some.
@register("billing_outliers_robust", """
WITH daily AS (SELECT usage_type, usage_date, sum(usage_quantity) AS qty FROM billing_usage GROUP BY 1, 2),
md AS (SELECT usage_type, median(qty) AS md FROM daily GROUP BY 1),
mad AS (SELECT usage_type, any_value(md) AS md, median(abs(qty - md)) AS mad FROM daily JOIN md USING (usage_type) GROUP BY 1),
z AS (SELECT usage_type, usage_date, qty, md, (qty - md) / (1.4826 * mad) AS z FROM daily JOIN mad USING (usage_type))
SELECT usage_type, usage_date, round(qty, 4) AS qty, round(md, 4) AS median, round(z, 4) AS robust_z FROM z WHERE abs(z) > 1.5""")
def q_billing_outliers_robust(spark, d):
    return D.billing_outliers_robust(tables(spark, d).billing_usage, 1.5)
