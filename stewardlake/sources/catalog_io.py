"""Sources and sinks: declared-schema reads, sample generators, table sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sampling import stable_unit

# Declared schemas of the tables the engine reads (no inference, no footer merge).
CATALOG_SCHEMAS: dict[str, str] = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
CATALOG_TABLES = list(CATALOG_SCHEMAS)


def load_catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every source table read with its declared schema."""
    d = sf_dir.rstrip("/")
    return {n: spark.read.schema(s).parquet(f"{d}/{n}.parquet") for n, s in CATALOG_SCHEMAS.items()}


def table_row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) for each frame: one aggregate per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """A5: row counts of all tables in one row (scalar subqueries)."""
    # Scalar subqueries keep this a single-row plan without joins.
    first_name, first = next(iter(frames.items()))
    row = first.agg(F.count(F.lit(1)).alias(first_name))
    for n, df in list(frames.items())[1:]:
        row = row.withColumn(n, df.select(F.count(F.lit(1))).scalar())
    return row


# ---- sample generators (S3, S4): distributed, seeded, no driver loop ------------
# FIXED VALUES of the sample tables.
REVENUE_REGIONS = ["West", "East", "Central", "South"]
BUSINESS_UNITS = ["Engineering", "Sales", "Operations", "Finance", "IT"]
SR_CATEGORIES = ["IT Support", "Facilities", "HR", "Finance", "General"]
SR_STATUSES = ["Open", "In Progress", "Resolved", "Closed"]
SR_PRIORITIES = ["Low", "Medium", "High", "Critical"]


def _pick(values: list[str], r) -> F.Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(r * len(values)) + 1).cast("int"))


def gen_revenue_summary(seed_frame: DataFrame, as_of: F.Column, seed: int = 42) -> DataFrame:
    """S3: one revenue row per input row (e.g. per order): unit, region, a
    period date within 365 days before as_of, budget 50k-5M and actual
    40k-4.8M, 2 decimals. Randomness is a fixed function of the row id and
    the seed, so reruns and recomputed partitions give the same rows."""
    rid = F.col("record_id")

    def u(salt: int):
        return stable_unit(rid, seed, salt)

    return seed_frame.select(
        rid,
        _pick(BUSINESS_UNITS, u(1)).alias("business_unit"),
        _pick(REVENUE_REGIONS, u(2)).alias("region"),
        (as_of - F.make_dt_interval(days=F.floor(u(3) * 365).cast("int"))).alias("period_date"),
        F.round(50_000 + u(4) * (5_000_000 - 50_000), 2).alias("budgeted_amount"),
        F.round(40_000 + u(5) * (4_800_000 - 40_000), 2).alias("actual_amount"),
    )


def gen_service_requests(seed_frame: DataFrame, as_of: F.Column, seed: int = 42) -> DataFrame:
    """Service requests with number SR-00001.., category, priority,
    status, created_at within 180 days, resolution_days 1-30 or NULL (~30%)."""
    rid = F.col("request_id")

    def u(salt: int):
        return stable_unit(rid, seed, salt)

    return seed_frame.select(
        rid,
        F.format_string("SR-%05d", rid).alias("request_number"),
        _pick(SR_CATEGORIES, u(1)).alias("category"),
        _pick(SR_PRIORITIES, u(2)).alias("priority"),
        _pick(SR_STATUSES, u(3)).alias("status"),
        (as_of - F.make_dt_interval(days=F.floor(u(4) * 180).cast("int"))).alias("created_at"),
        F.when(u(5) < 0.3, F.lit(None).cast("int")).otherwise((F.floor(u(6) * 30) + 1).cast("int")).alias("resolution_days"),
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Overwrite a parquet table at ``path`` (shared storage) and return
    the re-read table, so callers can report its count lazily."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def seed_if_absent(current: DataFrame, seed_rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert seed rows whose key is absent (left anti + union)."""
    return current.unionByName(seed_rows.join(current.select(*key), key, "left_anti"), allowMissingColumns=True)


def all_tables_present(spark: SparkSession, expected: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Expected table names minus the existing ones (catalog listing when
    ``existing`` is None)."""
    if existing is None:
        names = [t.name for t in spark.catalog.listTables()]
        existing = spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField("table_name", T.StringType())]))
    return expected.select("table_name").subtract(existing.select("table_name"))


# ---- time-partitioned storage -----------------------------------------------------------------
def write_by_month(df: DataFrame, path: str, time_col: str) -> DataFrame:
    """Store a fact table (requests, audit) partitioned by the month of
    ``time_col`` (``ym=yyyy-MM``), one task writing each month's rows of its
    partition; returns the stored table."""
    ym = F.date_format(F.col(time_col), "yyyy-MM")
    df.withColumn("ym", ym).write.mode("overwrite").partitionBy("ym").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Read the months first..last (``yyyy-MM``, inclusive) of a table stored
    by ``write_by_month``: the predicate is on the partition column, so only
    those folders are listed and scanned (partition pruning)."""
    return spark.read.parquet(path).filter((F.col("ym") >= first) & (F.col("ym") <= last))
