"""Metadata browsing, column classification and bulk registration
(S6-S8, J5, J6, J9, F1, F2, A9, A10, A12, A13, F12, U3, W4, M12-M14, A15).

The reference walks catalogs, schemas and tables with one API call each; here
the metadata are tables (``meta_tables``, ``meta_columns``,
``meta_column_tags``) and every step is one join or aggregate over all of
them. Per-table facts (PII present, tag map) are aggregated *before* they are
joined back, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import classify_sensitivity, elevated_pii, infer_domain, masked
from ..functions.grants import catalog_grant_lines
from ..functions.text import display_name
from .common import sequence_numbers


def full_name(catalog: str = "catalog_name", schema: str = "schema_name", table: str = "table_name") -> Column:
    return F.concat_ws(".", F.col(catalog), F.col(schema), F.col(table))


def _registered_names(products: DataFrame, lower: bool) -> DataFrame:
    n = F.col("uc_full_name")
    key = F.lower(n) if lower else n
    return products.filter(n.isNotNull()).select(key.alias("_reg")).distinct()


def _is_internal(table: Column) -> Column:
    cond = None
    for p in rules.INTERNAL_TABLE_PREFIXES:
        c = table.startswith(p)
        cond = c if cond is None else cond | c
    return cond


def registered_flag(meta_tables: DataFrame, products: DataFrame) -> DataFrame:
    """Every metadata table with a case-sensitive registered flag."""
    reg = _registered_names(products, lower=False).withColumn("registered", F.lit(True))
    t = meta_tables.withColumn("full_name", full_name())
    return t.join(reg, t.full_name == reg._reg, "left").select(
        "catalog_name", "schema_name", "table_name", "full_name", "table_type",
        F.coalesce("registered", F.lit(False)).alias("registered"))


def list_tables(meta_tables: DataFrame, products: DataFrame, catalog: str | None = None,
                schema: str | None = None) -> DataFrame:
    """Tables (of one schema when given) without internal prefixes, with
    the registered flag; presented sorted by name."""
    t = meta_tables
    if catalog:
        t = t.filter(F.col("catalog_name") == catalog)
    if schema:
        t = t.filter(F.col("schema_name") == schema)
    t = t.filter(~_is_internal(F.col("table_name")))
    return registered_flag(t, products)


def list_catalogs(meta_tables: DataFrame) -> DataFrame:
    """(catalog, schema) pairs except system catalogs and information_schema."""
    return (
        meta_tables.filter(~F.col("catalog_name").isin(*rules.HIDDEN_CATALOGS)
                           & ~F.col("schema_name").isin(*rules.HIDDEN_SCHEMAS))
        .select("catalog_name", "schema_name").distinct()
    )


def column_metadata(meta_columns: DataFrame) -> DataFrame:
    """Columns with upper-cased type and comment default ''."""
    comment = F.col("comment") if "comment" in meta_columns.columns else F.lit(None).cast("string")
    return meta_columns.select(
        "product_id", "column_name", F.upper("data_type").alias("data_type"),
        F.coalesce(comment, F.lit("")).alias("comment"), "ordinal_position")


def undiscovered_tables(meta_tables: DataFrame, products: DataFrame, prefix: str | None = None) -> DataFrame:
    """Metadata tables not registered (case-insensitive), optionally within
    a ``catalog.schema[.table_prefix]`` prefix."""
    t = meta_tables.withColumn("full_name", full_name())
    if prefix:
        parts = prefix.split(".")
        t = t.filter((F.col("catalog_name") == parts[0]) & (F.col("schema_name") == parts[1]))
        if len(parts) > 2 and parts[2]:
            t = t.filter(F.lower("table_name").startswith(parts[2].lower()))
    reg = _registered_names(products, lower=True)
    return t.join(reg, F.lower(t.full_name) == reg._reg, "left_anti").select(
        "catalog_name", "schema_name", "table_name", "full_name", "product_id", "updated_at")


def columns_with_tags(meta_columns: DataFrame, meta_column_tags: DataFrame) -> DataFrame:
    """Every column with a map of its tags (tag name -> value; for a name
    given twice the larger value is kept, deterministically)."""
    tags = (
        meta_column_tags.groupBy("product_id", "column_name", "tag_name").agg(F.max("tag_value").alias("tag_value"))
        .groupBy("product_id", "column_name")
        .agg(F.map_from_entries(F.collect_list(F.struct("tag_name", "tag_value"))).alias("tags"))
    )
    return meta_columns.join(tags, ["product_id", "column_name"], "left")


def classify_columns(cols_with_tags: DataFrame) -> DataFrame:
    """F1 + F2 per column: sensitivity, masked, elevated_pii."""
    sens = classify_sensitivity("column_name", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    return cols_with_tags.withColumn("sensitivity", sens).select(
        "product_id", "column_name", "ordinal_position", "sensitivity",
        masked("sensitivity").alias("masked"),
        elevated_pii("sensitivity", "column_name").alias("elevated_pii"))


def sensitivity_counts(classified: DataFrame) -> DataFrame:
    """PII, confidential and masked column counts per table."""
    return classified.groupBy("product_id").agg(
        F.count_if(F.col("sensitivity") == "PII").alias("pii_columns"),
        F.count_if(F.col("sensitivity") == "CONFIDENTIAL").alias("confidential_columns"),
        F.count_if("masked").alias("masked_columns"))


def table_has_pii(meta_columns: DataFrame) -> DataFrame:
    """A10: any column name with the PII prefix; confidential only when no PII."""
    name = F.col("column_name")
    agg = meta_columns.groupBy("product_id").agg(
        F.bool_or(name.rlike("(?i)" + rules.PII_NAME_PREFIX)).alias("has_pii"),
        F.bool_or(name.rlike("(?i)" + rules.CONFIDENTIAL_NAME_PREFIX)).alias("_any_conf"))
    return agg.select("product_id", "has_pii", ((~F.col("has_pii")) & F.col("_any_conf")).alias("has_confidential"))


def registration_rollup(flagged: DataFrame, selected: DataFrame) -> DataFrame:
    """Per (catalog, schema), per catalog and overall: tables, selectable
    (unregistered) and selected counts and the check state."""
    sel = selected.select("full_name").distinct().withColumn("is_selected", F.lit(True))
    t = flagged.join(sel, "full_name", "left")
    selectable = ~F.col("registered")
    picked = selectable & F.coalesce("is_selected", F.lit(False))
    agg = t.rollup("catalog_name", "schema_name").agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(selectable).alias("unregistered"),
        F.count_if(picked).alias("selected"))
    state = (
        F.when(F.col("unregistered") == 0, "none").when(F.col("selected") == 0, "unchecked")
        .when(F.col("selected") == F.col("unregistered"), "checked").otherwise("indeterminate"))
    return agg.withColumn("check_state", state)


def schema_visibility(meta_tables: DataFrame) -> DataFrame:
    """Visibility per (catalog, schema) as a service principal would see it:
    schemas of hidden catalogs cannot be listed; a schema holding
    pipeline-internal tables does not allow table listing without a grant."""
    return meta_tables.groupBy("catalog_name", "schema_name").agg(
        (~F.first(F.col("catalog_name").isin(*rules.HIDDEN_CATALOGS))).alias("can_list_schemas"),
        (~F.bool_or(_is_internal(F.col("table_name")))).alias("tables_visible"))


def catalog_access_summary(visibility: DataFrame) -> DataFrame:
    """Per catalog: accessible / needs_grant / no_access."""
    agg = visibility.groupBy("catalog_name").agg(
        F.bool_and("can_list_schemas").alias("can_list_schemas"),
        F.count_if(~F.col("tables_visible")).alias("schemas_needing_grant"))
    status = (
        F.when(~F.col("can_list_schemas"), "no_access")
        .when(F.col("schemas_needing_grant") > 0, "needs_grant").otherwise("accessible"))
    return agg.withColumn("access", status)


def catalog_grant_sql(summary: DataFrame, principal: str) -> DataFrame:
    """three GRANT lines per catalog that needs them."""
    return (
        summary.filter(F.col("access") == "needs_grant")
        .select("catalog_name", F.posexplode(catalog_grant_lines("catalog_name", F.lit(principal))).alias("line_no", "grant_sql"))
    )


def build_tags(domain: Column, has_pii: Column, has_conf: Column, source_tags: Column) -> Column:
    """Ordered set of domain (unless Other), 'Contains PII' or
    'Confidential', then the source tags (quotes removed); 'Dataset' if empty."""
    first = F.array_compact(F.array(
        F.when(domain.isNotNull() & (domain != rules.DOMAIN_DEFAULT), domain),
        F.when(has_pii, F.lit("Contains PII")),
        F.when(has_conf, F.lit("Confidential")),
    ))
    cleaned = F.transform(F.coalesce(source_tags, F.array().cast("array<string>")), lambda t: F.replace(t, F.lit('"'), F.lit("")))
    tags = F.array_distinct(F.concat(first, F.filter(cleaned, lambda t: F.trim(t) != "")))
    return F.when(F.size(tags) == 0, F.array(F.lit("Dataset"))).otherwise(tags)


def assign_refs(new_rows: DataFrame, products: DataFrame, order_col: str = "full_name", base: int = 0) -> DataFrame:
    """Sequential refs max + position (padded to 3), in ``order_col`` order."""
    num = F.substring("product_ref", 4, 1 << 20).try_cast("bigint")
    max_id = products.select(F.coalesce(F.max(num), F.lit(base)).alias("m")).scalar()
    seq = sequence_numbers(new_rows, [order_col], "pos")
    return seq.withColumn("product_ref", F.format_string("DP-%03d", max_id + F.col("pos"))).drop("pos")


PRODUCT_OUT = ["product_ref", "display_name", "description", "type", "domain", "tags", "source_system",
               "refresh_frequency", "owner_email", "classification", "uc_full_name", "is_active", "status", "last_refreshed"]


def import_tables(selected: DataFrame, meta_columns: DataFrame, products: DataFrame, as_of: Column,
                  table_tags: DataFrame | None = None) -> DataFrame:
    """Register the selected tables in one job: domain (F3), display name
    (F4), PII flags (A10), tags (U3), fallbacks, Published, refs (W4).
    ``selected`` has catalog_name, schema_name, table_name, full_name,
    product_id (metadata key), updated_at and optional comment / owner."""
    pii = table_has_pii(meta_columns)
    s = selected.join(pii, "product_id", "left")
    if table_tags is not None:
        s = s.join(table_tags.select("product_id", "table_tags"), "product_id", "left")
    else:
        s = s.withColumn("table_tags", F.lit(None).cast("array<string>"))
    comment = F.col("comment") if "comment" in s.columns else F.lit(None).cast("string")
    owner = F.col("owner") if "owner" in s.columns else F.lit(None).cast("string")
    dom = infer_domain("catalog_name", "schema_name")
    has_pii = F.coalesce("has_pii", F.lit(False))
    has_conf = F.coalesce("has_confidential", F.lit(False))
    rows = s.select(
        "full_name",
        display_name(F.col("table_name")).alias("display_name"),
        F.coalesce(F.nullif(comment, F.lit("")), F.concat(F.lit(rules.IMPORT_DESCRIPTION_PREFIX), F.col("full_name"))).alias("description"),
        F.lit("Dataset").alias("type"),
        dom.alias("domain"),
        build_tags(dom, has_pii, has_conf, F.col("table_tags")).alias("tags"),
        F.lit(rules.IMPORT_SOURCE_SYSTEM).alias("source_system"),
        F.lit("Daily").alias("refresh_frequency"),
        F.coalesce(F.nullif(owner, F.lit("")), F.lit(rules.IMPORT_OWNER_DEFAULT)).alias("owner_email"),
        F.lit("Internal").alias("classification"),
        F.col("full_name").alias("uc_full_name"),
        F.lit(True).alias("is_active"),
        F.lit("Published").alias("status"),
        F.coalesce(F.col("updated_at"), as_of).alias("last_refreshed"),
    )
    return assign_refs(rows, products).select(*PRODUCT_OUT)


def discover_drafts(meta_tables: DataFrame, products: DataFrame, prefix: str, as_of: Column) -> DataFrame:
    """Unregistered tables under ``prefix`` become inactive Draft products."""
    new = undiscovered_tables(meta_tables, products, prefix)
    rows = new.select(
        "full_name",
        display_name(F.col("table_name")).alias("display_name"),
        F.concat(F.lit(rules.DISCOVER_DESCRIPTION_PREFIX), F.col("full_name")).alias("description"),
        F.lit("Dataset").alias("type"),
        F.lit("Other").alias("domain"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(rules.IMPORT_SOURCE_SYSTEM).alias("source_system"),
        F.lit("Daily").alias("refresh_frequency"),
        F.lit("").alias("owner_email"),
        F.lit("Internal").alias("classification"),
        F.col("full_name").alias("uc_full_name"),
        F.lit(False).alias("is_active"),
        F.lit("Draft").alias("status"),
        as_of.alias("last_refreshed"),
    )
    return assign_refs(rows, products).select(*PRODUCT_OUT)


def sync_metadata(products: DataFrame, meta_tables: DataFrame, as_of: Column) -> DataFrame:
    """For products with a real table name, a vanished table marks the
    product Unavailable; otherwise last_refreshed takes the table's
    updated_at (as_of when unknown). updated_at becomes as_of for both.
    Returns the products touched with a ``sync`` column (synced/unavailable)."""
    n = F.col("uc_full_name")
    real = products.filter(n.isNotNull() & ~n.like(rules.PLACEHOLDER_NAME_LIKE))
    meta = meta_tables.select(F.lower(full_name()).alias("_name"), F.col("updated_at").alias("_meta_updated")) \
        .groupBy("_name").agg(F.max("_meta_updated").alias("_meta_updated"), F.max(F.lit(True)).alias("_exists"))
    j = real.join(meta, F.lower(n) == meta._name, "left")
    gone = F.col("_exists").isNull()
    return j.select(
        "product_id", "product_ref", "uc_full_name",
        F.when(gone, F.lit("Unavailable")).otherwise(F.col("status")).alias("status"),
        F.when(gone, F.col("last_refreshed")).otherwise(F.coalesce("_meta_updated", as_of)).alias("last_refreshed"),
        as_of.alias("updated_at"),
        F.when(gone, "unavailable").otherwise("synced").alias("sync"),
    )


def sync_counters(sync_plan: DataFrame) -> DataFrame:
    """Synced / unavailable / total of a sync run."""
    return sync_plan.agg(
        F.count_if(F.col("sync") == "synced").alias("synced"),
        F.count_if(F.col("sync") == "unavailable").alias("unavailable"),
        F.count(F.lit(1)).alias("total"))
