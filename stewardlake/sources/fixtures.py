"""Map the driver's star-schema tables onto the marketplace data model.

The mapping is column arithmetic over the given parquet tables, so every job
reads the whole input and its work grows with it. Only ``access_requests``
needs a join (lineitem x orders on the order key): a sort-merge join on a
well-spread key that AQE may turn into a broadcast when ``orders`` is small.
All time columns stay ``timestamp_ntz`` so results do not depend on the
session time zone.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping (shared with the SQL oracle).
PRODUCT_REFRESH_BASE = "2001-11-04 00:00:00"
META_UPDATED_BASE = "2001-08-01 00:00:00"
META_COLUMNS = [
    ("ssn_last4", "string", 1),
    ("email_address", "string", 2),
    ("budget_code", "string", 3),
    ("amount", "decimal(18,2)", 4),
    ("birth_date", "date", 5),
    ("region", "string", 6),
    ("my_email", "string", 7),
    ("salary_band", "string", 8),
]
TYPE_BY_SIZE_MOD5 = ["Dashboard", "Dataset", "Report", "Genie Space", "ML Model"]
SKU_BY_EVENT = [("view", "PREMIUM_SERVING"), ("click", "LAKEBASE_CU"), ("purchase", "FOUNDATION_MODEL_TOKENS")]
SKU_OTHER = "SQL_COMPUTE"


def ts_ntz(text: str) -> Column:
    """A timezone-free timestamp literal."""
    return F.lit(text).cast("timestamp_ntz")


def days(n: Column | int) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def hours(n: Column | int) -> Column:
    return F.make_dt_interval(hours=n if isinstance(n, Column) else F.lit(n))


def _case(col: Column, pairs: list[tuple[str, str]], default: str) -> Column:
    e = None
    for k, v in pairs:
        e = F.when(col == k, v) if e is None else e.when(col == k, v)
    return e.otherwise(default)


def _num(c: str) -> Column:
    return F.col(c).cast("string")


class Tables:
    """Lazily built marketplace frames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---- catalog ---------------------------------------------------------
    @cached_property
    def data_products(self) -> DataFrame:
        k = F.col("p_partkey")
        ref_num = F.when(k < 1000, F.lpad(_num("p_partkey"), 3, "0")).otherwise(_num("p_partkey"))
        full_name = F.concat(
            F.lower("p_type"), F.lit("."),
            F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))), F.lit("."),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), _num("p_partkey"),
        )
        size_mod5 = F.col("p_size") % 5
        size_mod4 = F.col("p_size") % 4
        tags_csv = F.concat_ws(
            ",",
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
            F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)),
            F.col("p_brand"),
        )
        return self.raw("part").select(
            k.alias("product_id"),
            F.concat(F.lit("DP-"), ref_num).alias("product_ref"),
            F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(full_name).alias("uc_full_name"),
            F.concat_ws(" ", F.col("p_name"), _num("p_partkey")).alias("display_name"),
            F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" from "), F.col("p_brand")).alias("description"),
            _case(size_mod5, list(enumerate(TYPE_BY_SIZE_MOD5[:-1])), TYPE_BY_SIZE_MOD5[-1]).alias("type"),
            F.when(k % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("domain"),
            tags_csv.alias("tags_csv"),
            F.split(tags_csv, ",").alias("tags"),
            F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("source_system"),
            F.when(size_mod4 == 0, "Daily").when(size_mod4 == 1, "Weekly").when(size_mod4 == 2, "Monthly")
            .otherwise("Annual").alias("refresh_frequency"),
            (k % 20 != 0).alias("is_active"),
            F.when(k % 20 == 0, "Pending").when(k % 33 == 0, F.lit(None).cast("string"))
            .otherwise("Published").alias("status"),
            F.when(k % 13 == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(ts_ntz(PRODUCT_REFRESH_BASE) - days(F.col("p_size"))).alias("last_refreshed"),
        )

    # ---- people ----------------------------------------------------------
    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey") % 10
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email"),
            F.col("c_name").alias("display_name"),
            F.when(k == 0, "data_steward").when(k == 1, "Admin").when(k == 2, "manager")
            .when(k == 3, F.lit(None).cast("string")).otherwise("analyst").alias("role"),
            F.col("c_mktsegment").alias("department"),
        )

    @cached_property
    def portal_groups(self) -> DataFrame:
        """One group per customer segment; its role follows from the number of its customers."""
        n = F.count(F.lit(1)) % 3
        return self.raw("customer").groupBy(F.col("c_mktsegment").alias("group_name")).agg(
            F.when(n == 0, "admin").when(n == 1, "steward").otherwise("analyst").alias("role"))

    # ---- requests --------------------------------------------------------
    @cached_property
    def access_requests(self) -> DataFrame:
        li = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
        od = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
        j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
        resolved = F.col("o_orderdate") + days(F.col("l_quantity").cast("int"))
        return j.select(
            F.concat_ws("-", _num("l_orderkey"), _num("l_linenumber"), _num("l_partkey"), _num("l_suppkey")).alias("request_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("o_custkey").alias("requester_id"),
            F.col("o_orderpriority").alias("business_reason"),
            F.when(F.col("l_returnflag") == "A", "Approved").when(F.col("l_returnflag") == "N", "Pending")
            .when(F.col("l_linestatus") == "F", "Denied").otherwise("Revoked").alias("status"),
            F.col("o_orderdate").alias("requested_at"),
            F.when(F.col("l_returnflag") == "N", F.lit(None).cast("timestamp_ntz")).otherwise(resolved).alias("resolved_at"),
            F.when(F.col("l_returnflag") == "A", resolved + days(90))
            .otherwise(F.lit(None).cast("timestamp_ntz")).alias("expires_at"),
        )

    # ---- audit / events --------------------------------------------------
    @cached_property
    def audit_log(self) -> DataFrame:
        return audit_log_from_events(self.raw("events"))

    @cached_property
    def user_library(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") == "click")
        return ev.select(
            "user_id",
            F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("product_id"),
        ).distinct()

    @cached_property
    def feature_requests(self) -> DataFrame:
        # One feature request per document (the whole table, no id subset); the
        # title is the whole text, so title search covers all of it.
        return self.raw("documents").select(
            F.col("doc_id").alias("request_id"),
            F.col("text").alias("title"),
            F.col("lang").alias("status_src"),
            F.col("source").alias("requester"),
        )

    @cached_property
    def feature_request_votes(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") == "view")
        return ev.select(
            F.regexp_extract("props", "[0-9]+", 0).cast("bigint").alias("request_id"),
            F.col("user_id").alias("voter_id"),
        ).distinct()

    @cached_property
    def billing_usage(self) -> DataFrame:
        et = F.col("event_type")
        return self.raw("events").select(
            F.col("ts").cast("date").alias("usage_date"),
            _case(et, SKU_BY_EVENT, SKU_OTHER).alias("sku_name"),
            et.alias("usage_type"),
            F.when(F.col("user_id") % 3 == 0, "portal").otherwise(F.lit(None).cast("string")).alias("tag_app"),
            F.col("value").alias("usage_quantity"),
        )

    @cached_property
    def access_log(self) -> DataFrame:
        et = F.col("event_type")
        u = F.col("user_id") % 5
        return self.raw("events").select(
            F.col("event_id").alias("log_id"),
            F.when(et == "view", "GET").when(et == "click", "POST").when(et == "purchase", "PUT")
            .when(et == "error", "DELETE").otherwise("GET").alias("method"),
            F.when(u == 0, "/api/portal/products/DP-001").when(u == 1, "/api/portal/products")
            .when(u == 2, "/api/portal/requests/REQ-001/approve").when(u == 3, "/api/health")
            .otherwise("/api/portal/something-new").alias("path"),
            "user_id",
        )

    # ---- metadata --------------------------------------------------------
    @cached_property
    def meta_tables(self) -> DataFrame:
        k = F.col("p_partkey")
        prefix = F.when(k % 50 == 3, "__dlt_").otherwise("")
        return self.raw("part").filter(k % 17 != 5).select(
            F.lower("p_type").alias("catalog_name"),
            F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("schema_name"),
            F.concat(prefix, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), _num("p_partkey")).alias("table_name"),
            F.lit("MANAGED").alias("table_type"),
            k.alias("product_id"),
            (ts_ntz(META_UPDATED_BASE) - hours(F.col("p_size"))).alias("updated_at"),
        )

    @cached_property
    def meta_columns(self) -> DataFrame:
        # The column list is a fixed 8-entry literal expanded per table with a
        # generator (inline), so there is no join at all.
        cols = F.array(*[
            F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type"), F.lit(o).alias("ordinal_position"))
            for n, t, o in META_COLUMNS
        ])
        return (
            self.raw("part").select(F.col("p_partkey").alias("product_id"), F.inline(cols))
            .filter((F.col("product_id") + F.col("ordinal_position")) % 3 != 0)
        )

    @cached_property
    def meta_column_tags(self) -> DataFrame:
        mc = self.meta_columns.filter((F.col("column_name") == "region") & (F.col("product_id") % 5 == 0))
        return mc.select(
            "product_id", "column_name",
            F.when(F.col("product_id") % 2 == 0, "sensitivity_level").otherwise("sensitivity").alias("tag_name"),
            F.when(F.col("product_id") % 4 == 0, "pii").otherwise("Confidential").alias("tag_value"),
        )

    @cached_property
    def customer_profile(self) -> DataFrame:
        """A customer table with the column names the classifier knows, for
        masking jobs (every value is derived from ``customer``)."""
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("customer_id"),
            F.lpad((k % 10000).cast("string"), 4, "0").alias("ssn_last4"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.org")).alias("email_address"),
            F.col("c_mktsegment").alias("budget_code"),
            F.col("c_acctbal").alias("amount"),
            F.date_add(F.lit("1970-01-01").cast("date"), (k % 10000).cast("int")).alias("birth_date"),
            F.col("c_nationkey").cast("string").alias("region"),
        )

    # ---- text ------------------------------------------------------------
    @cached_property
    def conversations(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")


def audit_log_from_events(events: DataFrame) -> DataFrame:
    """Audit rows from the ``events`` shape (works on batch and stream frames)."""
    et = F.col("event_type")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.when(et == "view", "REQUEST_SUBMITTED").when(et == "click", "NUDGE_SENT")
        .when(et == "purchase", "REQUEST_APPROVED").when(et == "error", "REQUEST_DENIED")
        .otherwise("PRODUCT_SUBMITTED").alias("event_type"),
        F.col("user_id").alias("actor_id"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("occurred_at"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
