"""Registered metadata and classification queries
(S6-S8, J5, J6, J9, F1-F4, A9, A10, A12, A13, F12, U3, W4, M12-M14, A15)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import infer_domain
from ..functions.text import display_name
from ..operators import metadata as M
from ..session import checkpoint_subdir
from ..sources import listing as L
from ..sources.fixtures import tables
from .params import REQUESTS_AS_OF_TEXT, requests_as_of
from .registry import register

AS_OF = f"TIMESTAMP '{REQUESTS_AS_OF_TEXT}'"
FULL = "catalog_name || '.' || schema_name || '.' || table_name"
# FIXED VALUES, stated here once more so that the oracles do not share the library's rule tables.
INTERNAL = """starts_with(table_name, '__materialization_mat_') OR starts_with(table_name, '__apply_changes_')
  OR starts_with(table_name, 'event_log_') OR starts_with(table_name, '__dlt_')"""
PII_RE = "(?i)^(ssn|social_security|dob|date_of_birth|birth_date|email|phone|address|bank_account|credit_card|salary|compensation|wage)"
CONF_RE = "(?i)^(cost_center|approver|budget_code|account_number|internal_id)"
ELEV_RE = "(?i)ssn|dob|date_of_birth|birth|bank|credit_card"
SP = "stewardlake-sp"


def word_caps_sql(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\w+|\\W+'), "
            f"lambda w: CASE WHEN regexp_matches(w, '^\\w') THEN upper(w[1]) || w[2:] ELSE w END), '')")


def display_name_sql(x: str) -> str:
    inner = f"trim(regexp_replace(regexp_replace({x}, '_', ' ', 'g'), '(?i)^(.*?)\\bgold\\b', '\\1'))"
    return word_caps_sql(inner)


def infer_domain_sql(cat: str, sch: str) -> str:
    s = f"lower(COALESCE({cat}, '') || ' ' || COALESCE({sch}, ''))"
    return f"""CASE WHEN regexp_matches({s}, 'finance|budget|payroll|revenue|billing|accounting|expenditure') THEN 'Finance'
 WHEN regexp_matches({s}, 'hr|human.resource|employee|headcount|workforce|hris') THEN 'HR'
 WHEN regexp_matches({s}, 'health|clinical|patient|medical|pharma') THEN 'Healthcare'
 WHEN regexp_matches({s}, 'fire|police|ems|safety|emergency|incident|911') THEN 'Public Safety'
 WHEN regexp_matches({s}, 'sales|customer|crm|marketing|retail|ecommerce') THEN 'Sales & Marketing'
 WHEN regexp_matches({s}, 'geo|gis|spatial|map|location|address') THEN 'Geospatial'
 WHEN regexp_matches({s}, 'weather|forecast|climate|accuweather') THEN 'Weather'
 WHEN regexp_matches({s}, 'tax|property|assessment|parcel') THEN 'Property Tax'
 WHEN regexp_matches({s}, 'supply|inventory|logistics|warehouse|procurement') THEN 'Operations'
 WHEN regexp_matches({s}, 'nyctaxi|transit|transport|trip|vehicle') THEN 'Transportation'
 WHEN regexp_matches({s}, 'bakehouse|restaurant|food|hospitality|hotel|wander') THEN 'Hospitality'
 WHEN regexp_matches({s}, 'audit|compliance|risk|governance') THEN 'Compliance' ELSE 'Other' END"""


FLAGGED = f"""flagged AS (
 SELECT catalog_name, schema_name, table_name, {FULL} AS full_name, table_type,
  {FULL} IN (SELECT uc_full_name FROM data_products WHERE uc_full_name IS NOT NULL) AS registered
 FROM meta_tables)"""
CLASSIFIED = f"""tagmap AS (
 SELECT product_id, column_name, max(tag_value) FILTER (WHERE tag_name = 'sensitivity_level') AS t_level,
  max(tag_value) FILTER (WHERE tag_name = 'sensitivity') AS t_sens
 FROM meta_column_tags GROUP BY 1, 2),
classified AS (
 SELECT c.product_id, c.column_name, c.ordinal_position,
  COALESCE(NULLIF(upper(COALESCE(NULLIF(t.t_level, ''), NULLIF(t.t_sens, ''))), ''),
   CASE WHEN regexp_matches(c.column_name, '{PII_RE}') THEN 'PII' WHEN regexp_matches(c.column_name, '{CONF_RE}') THEN 'CONFIDENTIAL'
        ELSE 'INTERNAL' END) AS sensitivity
 FROM meta_columns c LEFT JOIN tagmap t ON t.product_id = c.product_id AND t.column_name = c.column_name)"""
PII_FLAGS = f"""pii AS (
 SELECT product_id, bool_or(regexp_matches(column_name, '{PII_RE}')) AS has_pii,
  NOT bool_or(regexp_matches(column_name, '{PII_RE}')) AND bool_or(regexp_matches(column_name, '{CONF_RE}')) AS has_confidential
 FROM meta_columns GROUP BY product_id)"""
HIDDEN_CATALOGS_SQL = "('system', '__databricks_internal', 'hive_metastore')"
VISIBILITY = f"""vis AS (
 SELECT catalog_name, schema_name, NOT first(catalog_name IN {HIDDEN_CATALOGS_SQL}) AS can_list_schemas,
  NOT bool_or({INTERNAL}) AS tables_visible FROM meta_tables GROUP BY 1, 2),
summary AS (
 SELECT catalog_name, bool_and(can_list_schemas) AS can_list_schemas, count(*) FILTER (WHERE NOT tables_visible) AS schemas_needing_grant
 FROM vis GROUP BY 1)"""


@register("list_tables", f"WITH {FLAGGED} SELECT * FROM flagged WHERE NOT ({INTERNAL})")
def q_list_tables(spark, d):
    t = tables(spark, d)
    return M.list_tables(t.meta_tables, t.data_products)


@register("registered_flag", f"WITH {FLAGGED} SELECT * FROM flagged")
def q_registered_flag(spark, d):
    t = tables(spark, d)
    return M.registered_flag(t.meta_tables, t.data_products)


@register("list_catalogs", f"""SELECT DISTINCT catalog_name, schema_name FROM meta_tables
WHERE catalog_name NOT IN {HIDDEN_CATALOGS_SQL} AND schema_name <> 'information_schema'""")
def q_list_catalogs(spark, d):
    return M.list_catalogs(tables(spark, d).meta_tables)


@register("column_metadata", "SELECT product_id, column_name, upper(data_type) AS data_type, '' AS comment, ordinal_position FROM meta_columns")
def q_column_metadata(spark, d):
    return M.column_metadata(tables(spark, d).meta_columns)


@register("undiscovered_tables", f"""SELECT catalog_name, schema_name, table_name, {FULL} AS full_name, product_id, updated_at
FROM meta_tables WHERE lower({FULL}) NOT IN (SELECT lower(uc_full_name) FROM data_products WHERE uc_full_name IS NOT NULL)""")
def q_undiscovered_tables(spark, d):
    t = tables(spark, d)
    return M.undiscovered_tables(t.meta_tables, t.data_products)


@register("columns_with_tags", """
SELECT c.product_id, c.column_name, c.data_type, c.ordinal_position, t.tags FROM meta_columns c LEFT JOIN (
 SELECT product_id, column_name, string_agg(tag_name || '=' || tag_value, '|' ORDER BY tag_name || '=' || tag_value) AS tags
 FROM (SELECT product_id, column_name, tag_name, max(tag_value) AS tag_value FROM meta_column_tags GROUP BY 1, 2, 3) GROUP BY 1, 2
) t ON t.product_id = c.product_id AND t.column_name = c.column_name""")
def q_columns_with_tags(spark, d):
    t = tables(spark, d)
    return M.columns_with_tags(t.meta_columns, t.meta_column_tags)


@register("classify_sensitivity", f"""WITH {CLASSIFIED}
SELECT product_id, column_name, ordinal_position, sensitivity, sensitivity IN ('PII','CONFIDENTIAL') AS masked,
 sensitivity = 'PII' AND regexp_matches(column_name, '{PII_RE}') AND regexp_matches(column_name, '{ELEV_RE}') AS elevated_pii
FROM classified""")
def q_classify_sensitivity(spark, d):
    t = tables(spark, d)
    return M.classify_columns(M.columns_with_tags(t.meta_columns, t.meta_column_tags))


@register("sensitivity_counts", f"""WITH {CLASSIFIED}
SELECT product_id, count(*) FILTER (WHERE sensitivity = 'PII') AS pii_columns,
 count(*) FILTER (WHERE sensitivity = 'CONFIDENTIAL') AS confidential_columns,
 count(*) FILTER (WHERE sensitivity IN ('PII','CONFIDENTIAL')) AS masked_columns
FROM classified GROUP BY product_id""")
def q_sensitivity_counts(spark, d):
    t = tables(spark, d)
    return M.sensitivity_counts(M.classify_columns(M.columns_with_tags(t.meta_columns, t.meta_column_tags)))


@register("table_has_pii", f"WITH {PII_FLAGS} SELECT * FROM pii")
def q_table_has_pii(spark, d):
    return M.table_has_pii(tables(spark, d).meta_columns)


@register("infer_domain", f"""SELECT catalog_name, schema_name, {infer_domain_sql('catalog_name', 'schema_name')} AS domain
FROM (SELECT DISTINCT catalog_name, schema_name FROM meta_tables)""")
def q_infer_domain(spark, d):
    mt = tables(spark, d).meta_tables.select("catalog_name", "schema_name").distinct()
    return mt.select("catalog_name", "schema_name", infer_domain("catalog_name", "schema_name").alias("domain"))


@register("display_name", f"SELECT product_id, table_name, {display_name_sql('table_name')} AS display_name FROM meta_tables")
def q_display_name(spark, d):
    mt = tables(spark, d).meta_tables
    return mt.select("product_id", "table_name", display_name("table_name").alias("display_name"))


# Selection for the rollup: every unregistered table of catalog 'promo'.
@register("registration_rollup", f"""WITH {FLAGGED},
f AS (SELECT * FROM flagged WHERE NOT ({INTERNAL})),
g AS (SELECT catalog_name, schema_name, count(*) AS tables, count(*) FILTER (WHERE NOT registered) AS unregistered,
       count(*) FILTER (WHERE NOT registered AND catalog_name = 'promo') AS selected
      FROM f GROUP BY ROLLUP (catalog_name, schema_name))
SELECT *, CASE WHEN unregistered = 0 THEN 'none' WHEN selected = 0 THEN 'unchecked' WHEN selected = unregistered THEN 'checked'
 ELSE 'indeterminate' END AS check_state FROM g""")
def q_registration_rollup(spark, d):
    t = tables(spark, d)
    flagged = M.list_tables(t.meta_tables, t.data_products)
    selected = flagged.filter(~F.col("registered") & (F.col("catalog_name") == "promo")).select("full_name")
    return M.registration_rollup(flagged, selected)


@register("catalog_access_summary", f"""WITH {VISIBILITY}
SELECT *, CASE WHEN NOT can_list_schemas THEN 'no_access' WHEN schemas_needing_grant > 0 THEN 'needs_grant' ELSE 'accessible' END AS access
FROM summary""")
def q_catalog_access_summary(spark, d):
    return M.catalog_access_summary(M.schema_visibility(tables(spark, d).meta_tables))


@register("catalog_grant_sql", f"""WITH {VISIBILITY}
SELECT catalog_name, g.line_no, 'GRANT ' || g.priv || ' ON CATALOG `' || replace(catalog_name, '`', '``') || '` TO `{SP}`;' AS grant_sql
FROM summary CROSS JOIN (VALUES (0, 'USE CATALOG'), (1, 'USE SCHEMA'), (2, 'SELECT')) AS g(line_no, priv)
WHERE can_list_schemas AND schemas_needing_grant > 0""")
def q_catalog_grant_sql(spark, d):
    return M.catalog_grant_sql(M.catalog_access_summary(M.schema_visibility(tables(spark, d).meta_tables)), SP)


def _build_tags_sql():
    return ("CASE WHEN len(tl) = 0 THEN 'Dataset' ELSE array_to_string(tl, '|') END")


IMPORT_ROWS = f"""sel AS (
 SELECT f.*, m.product_id AS meta_id, m.updated_at FROM flagged f
 JOIN (SELECT *, {FULL} AS fn FROM meta_tables) m ON m.fn = f.full_name
 WHERE NOT f.registered AND NOT ({INTERNAL.replace('table_name', 'f.table_name')})),
rows AS (
 SELECT s.full_name, s.table_name, s.catalog_name, s.schema_name, s.updated_at,
  {infer_domain_sql('s.catalog_name', 's.schema_name')} AS domain, COALESCE(p.has_pii, FALSE) AS has_pii,
  COALESCE(p.has_confidential, FALSE) AS has_conf
 FROM sel s LEFT JOIN pii p ON p.product_id = s.meta_id),
mx AS (SELECT COALESCE(max(TRY_CAST(substring(product_ref, 4) AS INTEGER)), 0) AS m FROM data_products)"""


@register("build_tags", f"""WITH {FLAGGED}, {PII_FLAGS}, {IMPORT_ROWS}
SELECT full_name, {_build_tags_sql()} AS tags FROM (
 SELECT full_name, list_filter([CASE WHEN domain <> 'Other' THEN domain END, CASE WHEN has_pii THEN 'Contains PII' END,
  CASE WHEN has_conf THEN 'Confidential' END], lambda x: x IS NOT NULL) AS tl FROM rows)""")
def q_build_tags(spark, d):
    t = tables(spark, d)
    sel = _import_selection(t)
    pii = M.table_has_pii(t.meta_columns)
    s = sel.join(pii, "product_id", "left")
    dom = infer_domain("catalog_name", "schema_name")
    return s.select("full_name", M.build_tags(dom, F.coalesce("has_pii", F.lit(False)),
                                              F.coalesce("has_confidential", F.lit(False)),
                                              F.lit(None).cast("array<string>")).alias("tags"))


def _import_selection(t):
    """Tables offered for import: listed (no internal prefix) and unregistered."""
    flagged = M.list_tables(t.meta_tables, t.data_products).filter(~F.col("registered")).select("full_name")
    mt = t.meta_tables.withColumn("full_name", M.full_name())
    return mt.join(flagged, "full_name", "left_semi")


@register("assign_refs", f"""WITH {FLAGGED}, {PII_FLAGS}, {IMPORT_ROWS}
SELECT full_name, printf('DP-%03d', mx.m + row_number() OVER (ORDER BY full_name)) AS product_ref FROM rows, mx""")
def q_assign_refs(spark, d):
    t = tables(spark, d)
    return M.assign_refs(_import_selection(t).select("full_name"), t.data_products)


@register("import_tables", f"""WITH {FLAGGED}, {PII_FLAGS}, {IMPORT_ROWS}
SELECT printf('DP-%03d', mx.m + row_number() OVER (ORDER BY full_name)) AS product_ref,
 {display_name_sql('table_name')} AS display_name, '{rules.IMPORT_DESCRIPTION_PREFIX}' || full_name AS description, 'Dataset' AS type, domain,
 CASE WHEN len(tl) = 0 THEN 'Dataset' ELSE array_to_string(tl, '|') END AS tags, '{rules.IMPORT_SOURCE_SYSTEM}' AS source_system, 'Daily' AS refresh_frequency,
 '{rules.IMPORT_OWNER_DEFAULT}' AS owner_email, 'Internal' AS classification, full_name AS uc_full_name, TRUE AS is_active, 'Published' AS status,
 COALESCE(updated_at, {AS_OF}) AS last_refreshed
FROM (SELECT *, list_filter([CASE WHEN domain <> 'Other' THEN domain END, CASE WHEN has_pii THEN 'Contains PII' END,
  CASE WHEN has_conf THEN 'Confidential' END], lambda x: x IS NOT NULL) AS tl FROM rows), mx""")
def q_import_tables(spark, d):
    t = tables(spark, d)
    return M.import_tables(_import_selection(t), t.meta_columns, t.data_products, requests_as_of())


DISCOVER_PREFIX = "promo.brand_1"


@register("discover_drafts", f"""
SELECT printf('DP-%03d', (SELECT COALESCE(max(TRY_CAST(substring(product_ref, 4) AS INTEGER)), 0) FROM data_products)
  + row_number() OVER (ORDER BY full_name)) AS product_ref,
 {display_name_sql('table_name')} AS display_name, '{rules.DISCOVER_DESCRIPTION_PREFIX}' || full_name AS description, 'Dataset' AS type,
 'Other' AS domain, '' AS tags, '{rules.IMPORT_SOURCE_SYSTEM}' AS source_system, 'Daily' AS refresh_frequency, '' AS owner_email,
 'Internal' AS classification, full_name AS uc_full_name, FALSE AS is_active, 'Draft' AS status, {AS_OF} AS last_refreshed
FROM (SELECT *, {FULL} AS full_name FROM meta_tables WHERE catalog_name = 'promo' AND schema_name = 'brand_1') m
WHERE lower(full_name) NOT IN (SELECT lower(uc_full_name) FROM data_products WHERE uc_full_name IS NOT NULL)""")
def q_discover_drafts(spark, d):
    t = tables(spark, d)
    return M.discover_drafts(t.meta_tables, t.data_products, DISCOVER_PREFIX, requests_as_of())


SYNC = f"""sync AS (
 SELECT p.product_id, p.product_ref, p.uc_full_name,
  CASE WHEN m.n IS NULL THEN 'Unavailable' ELSE p.status END AS status,
  CASE WHEN m.n IS NULL THEN p.last_refreshed ELSE COALESCE(m.u, {AS_OF}) END AS last_refreshed,
  {AS_OF} AS updated_at, CASE WHEN m.n IS NULL THEN 'unavailable' ELSE 'synced' END AS sync
 FROM data_products p LEFT JOIN (SELECT lower({FULL}) AS n, max(updated_at) AS u FROM meta_tables GROUP BY 1) m
  ON m.n = lower(p.uc_full_name)
 WHERE p.uc_full_name IS NOT NULL AND p.uc_full_name NOT LIKE 'your_catalog.%')"""


@register("sync_metadata", f"WITH {SYNC} SELECT * FROM sync")
def q_sync_metadata(spark, d):
    t = tables(spark, d)
    return M.sync_metadata(t.data_products, t.meta_tables, requests_as_of())


@register("sync_counters", f"""WITH {SYNC}
SELECT count(*) FILTER (WHERE sync = 'synced') AS synced, count(*) FILTER (WHERE sync = 'unavailable') AS unavailable,
 count(*) AS total FROM sync""")
def q_sync_counters(spark, d):
    t = tables(spark, d)
    return M.sync_counters(M.sync_metadata(t.data_products, t.meta_tables, requests_as_of()))


# Two listings for the diff: the given columns, and the same after changes in the schemas brand_1*: ssn_last4 is
# dropped, amount gets another type, region another tag, my_email a sibling contact_email.
RETAG = '[{"key":"sensitivity","value":"internal"}]'
LISTINGS = f"""old AS (
 SELECT catalog_name, schema_name, table_name, c.column_name, c.data_type,
  CASE WHEN g.tag_name IS NOT NULL THEN '[{{"key":"' || g.tag_name || '","value":"' || g.tag_value || '"}}]' END AS tags
 FROM meta_tables t JOIN meta_columns c ON c.product_id = t.product_id
 LEFT JOIN meta_column_tags g ON g.product_id = c.product_id AND g.column_name = c.column_name),
new AS (
 SELECT * REPLACE (CASE WHEN column_name = 'amount' AND schema_name LIKE 'brand\\_1%' ESCAPE '\\' THEN 'decimal(20,4)' ELSE data_type END AS data_type,
  CASE WHEN column_name = 'region' AND schema_name LIKE 'brand\\_1%' ESCAPE '\\' THEN '{RETAG}' ELSE tags END AS tags)
 FROM old WHERE NOT (column_name = 'ssn_last4' AND schema_name LIKE 'brand\\_1%' ESCAPE '\\')
 UNION ALL
 SELECT * REPLACE ('contact_email' AS column_name) FROM old WHERE column_name = 'my_email' AND schema_name LIKE 'brand\\_1%' ESCAPE '\\'),
both_sides AS (
 SELECT catalog_name, schema_name, table_name, column_name, o.data_type AS old_type, n.data_type AS new_type, o.tags AS old_tags,
  n.tags AS new_tags, o.data_type IS NULL AS is_new, n.data_type IS NULL AS is_gone
 FROM old o FULL JOIN new n USING (catalog_name, schema_name, table_name, column_name))"""


def _listings(spark, d):
    t = tables(spark, d)
    old = L.column_listing(t.meta_tables, M.columns_with_tags(t.meta_columns, t.meta_column_tags))
    here, name = F.col("schema_name").startswith("brand_1"), F.col("column_name")
    new = old.filter(~(here & (name == "ssn_last4"))).withColumn(
        "data_type", F.when(here & (name == "amount"), "decimal(20,4)").otherwise(F.col("data_type"))).withColumn(
        "tags", F.when(here & (name == "region"), RETAG).otherwise(F.col("tags"))).unionByName(
        old.filter(here & (name == "my_email")).withColumn("column_name", F.lit("contact_email")))
    base = checkpoint_subdir(spark, f"listing_{uuid.uuid4().hex[:12]}")
    return L.Listing(spark, f"{base}/old").write(old), L.Listing(spark, f"{base}/new").write(new)


@register("metadata_changes", f"""WITH {LISTINGS}
SELECT catalog_name, schema_name, table_name, column_name, change, old_type, new_type, old_tags, new_tags FROM (
 SELECT *, 'added' AS change FROM both_sides WHERE is_new UNION ALL
 SELECT *, 'dropped' FROM both_sides WHERE is_gone UNION ALL
 SELECT *, 'retyped' FROM both_sides WHERE NOT is_new AND NOT is_gone AND old_type <> new_type UNION ALL
 SELECT *, 'retagged' FROM both_sides WHERE NOT is_new AND NOT is_gone AND old_tags IS DISTINCT FROM new_tags)""")
def q_metadata_changes(spark, d):
    return L.changes(*_listings(spark, d))
