"""The fixture mapping as DuckDB SQL, used as CTEs by the oracle queries.

Each entry mirrors the DataFrame builder of the same name in
``stewardlake.sources.fixtures``. ``with_tables`` prepends only the CTEs a
query needs (and their dependencies).
"""

from __future__ import annotations

import re

MAPPING: dict[str, str] = {
    "data_products": """
SELECT p_partkey AS product_id,
 'DP-' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR),3,'0') ELSE CAST(p_partkey AS VARCHAR) END AS product_ref,
 CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE lower(p_type) || '.' || lower(replace(p_brand,'#','_')) || '.' || replace(p_name,' ','_') || '_' || CAST(p_partkey AS VARCHAR) END AS uc_full_name,
 p_name || ' ' || CAST(p_partkey AS VARCHAR) AS display_name,
 p_type || ' ' || p_name || ' from ' || p_brand AS description,
 CASE p_size % 5 WHEN 0 THEN 'Dashboard' WHEN 1 THEN 'Dataset' WHEN 2 THEN 'Report' WHEN 3 THEN 'Genie Space' ELSE 'ML Model' END AS type,
 CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE p_type END AS domain,
 split_part(p_name,' ',1) || ',' || split_part(p_name,' ',2) || ',' || p_brand AS tags_csv,
 string_split(split_part(p_name,' ',1) || ',' || split_part(p_name,' ',2) || ',' || p_brand, ',') AS tags,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS source_system,
 CASE p_size % 4 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Weekly' WHEN 2 THEN 'Monthly' ELSE 'Annual' END AS refresh_frequency,
 p_partkey % 20 <> 0 AS is_active,
 CASE WHEN p_partkey % 20 = 0 THEN 'Pending' WHEN p_partkey % 33 = 0 THEN NULL ELSE 'Published' END AS status,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE TIMESTAMP '2001-11-04 00:00:00' - p_size * INTERVAL '1' DAY END AS last_refreshed
 FROM part""",
    "users": """
SELECT c_custkey AS user_id, lower(replace(c_name,'#','.')) || '@example.org' AS email,
 c_name AS display_name, CASE c_custkey % 10 WHEN 0 THEN 'data_steward' WHEN 1 THEN 'Admin' WHEN 2 THEN 'manager' WHEN 3 THEN NULL ELSE 'analyst' END AS role,
 c_mktsegment AS department FROM customer""",
    "access_requests": """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS request_id, l_partkey AS product_id, o_custkey AS requester_id, o_orderpriority AS business_reason,
 CASE WHEN l_returnflag = 'A' THEN 'Approved' WHEN l_returnflag = 'N' THEN 'Pending' WHEN l_linestatus = 'F' THEN 'Denied' ELSE 'Revoked' END AS status,
 o_orderdate AS requested_at, CASE WHEN l_returnflag = 'N' THEN NULL ELSE o_orderdate + CAST(l_quantity AS INT) * INTERVAL '1' DAY END AS resolved_at,
 CASE WHEN l_returnflag = 'A' THEN o_orderdate + CAST(l_quantity AS INT) * INTERVAL '1' DAY + INTERVAL '90' DAY ELSE NULL END AS expires_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "audit_log": """
SELECT event_id AS log_id, CASE event_type WHEN 'view' THEN 'REQUEST_SUBMITTED' WHEN 'click' THEN 'NUDGE_SENT' WHEN 'purchase' THEN 'REQUEST_APPROVED' WHEN 'error' THEN 'REQUEST_DENIED' ELSE 'PRODUCT_SUBMITTED' END AS event_type,
 user_id AS actor_id, props AS metadata, ts AS occurred_at FROM events""",
    "user_library": """
SELECT DISTINCT user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS product_id FROM events WHERE event_type = 'click'""",
    "feature_requests": """
SELECT doc_id AS request_id, text AS title, lang AS status_src, source AS requester FROM documents""",
    "feature_request_votes": """
SELECT DISTINCT CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS request_id, user_id AS voter_id FROM events WHERE event_type = 'view'""",
    "billing_usage": """
SELECT CAST(ts AS DATE) AS usage_date, CASE event_type WHEN 'view' THEN 'PREMIUM_SERVING' WHEN 'click' THEN 'LAKEBASE_CU' WHEN 'purchase' THEN 'FOUNDATION_MODEL_TOKENS' ELSE 'SQL_COMPUTE' END AS sku_name, event_type AS usage_type, CASE WHEN user_id % 3 = 0 THEN 'portal' ELSE NULL END AS tag_app, value AS usage_quantity FROM events""",
    "meta_tables": """
SELECT lower(p_type) AS catalog_name, lower(replace(p_brand,'#','_')) AS schema_name,
 CASE WHEN p_partkey % 50 = 3 THEN '__dlt_' ELSE '' END || replace(p_name,' ','_') || '_' || CAST(p_partkey AS VARCHAR) AS table_name,
 'MANAGED' AS table_type, p_partkey AS product_id, TIMESTAMP '2001-08-01 00:00:00' - p_size * INTERVAL '1' HOUR AS updated_at
 FROM part WHERE p_partkey % 17 <> 5""",
    "meta_columns": """
SELECT p_partkey AS product_id, c.column_name, c.data_type, c.ordinal_position FROM part
 JOIN (VALUES ('ssn_last4','string',1),('email_address','string',2),('budget_code','string',3),('amount','decimal(18,2)',4),('birth_date','date',5),('region','string',6),('my_email','string',7),('salary_band','string',8)) AS c(column_name,data_type,ordinal_position)
 ON (p_partkey + c.ordinal_position) % 3 <> 0""",
    "meta_column_tags": """
SELECT product_id, column_name, CASE WHEN product_id % 2 = 0 THEN 'sensitivity_level' ELSE 'sensitivity' END AS tag_name,
 CASE WHEN product_id % 4 = 0 THEN 'pii' ELSE 'Confidential' END AS tag_value
 FROM meta_columns WHERE column_name = 'region' AND product_id % 5 = 0""",
    "portal_groups": """
SELECT c_mktsegment AS group_name, CASE count(*) % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'steward' ELSE 'analyst' END AS role
FROM customer GROUP BY c_mktsegment
""",
    "access_log": """
SELECT event_id AS log_id, CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
 CASE user_id % 5 WHEN 0 THEN '/api/portal/products/DP-001' WHEN 1 THEN '/api/portal/products' WHEN 2 THEN '/api/portal/requests/REQ-001/approve' WHEN 3 THEN '/api/health' ELSE '/api/portal/something-new' END AS path, user_id FROM events""",
    "customer_profile": """
SELECT c_custkey AS customer_id, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn_last4,
 lower(replace(c_name,'#','.')) || '@example.org' AS email_address, c_mktsegment AS budget_code, c_acctbal AS amount,
 CAST(DATE '1970-01-01' + CAST(c_custkey % 10000 AS INTEGER) AS DATE) AS birth_date, CAST(c_nationkey AS VARCHAR) AS region FROM customer""",
}

# CTEs that read other CTEs.
DEPENDS = {"meta_column_tags": ["meta_columns"]}


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the mapping CTEs whose names it mentions."""
    needed: list[str] = []

    def add(name: str) -> None:
        for dep in DEPENDS.get(name, []):
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in MAPPING:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({MAPPING[n].strip()})" for n in needed)
    if re.match(r"(?i)^WITH\s", body):
        # The query has CTEs of its own: append them after the mapping.
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
