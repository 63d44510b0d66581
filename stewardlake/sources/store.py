"""Stored marketplace tables: write the mapped tables once in a production
layout and read them back through the same interface as ``Tables``.

Facts are partitioned by month (requests by ``requested_at``, audit events by
``occurred_at``) so time-bounded reads prune folders; dimensions are plain
parquet. Every job takes DataFrames, so it runs unchanged on either source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_io import read_months
from .fixtures import Tables

DIMENSIONS = ["data_products", "users", "portal_groups", "user_library", "feature_requests", "feature_request_votes",
              "billing_usage", "meta_tables", "meta_columns", "meta_column_tags", "customer_profile", "access_log",
              "conversations", "documents"]
FACTS_BY_MONTH = {"access_requests": "requested_at", "audit_log": "occurred_at"}


def store_marketplace(tables: Tables, base: str) -> None:
    """Write every mapped table under ``base`` (shared storage)."""
    base = base.rstrip("/")
    for name in DIMENSIONS:
        getattr(tables, name).write.mode("overwrite").parquet(f"{base}/{name}")
    for name, time_col in FACTS_BY_MONTH.items():
        df = getattr(tables, name)
        df.withColumn("ym", F.date_format(F.col(time_col), "yyyy-MM")).write.mode("overwrite") \
            .partitionBy("ym").parquet(f"{base}/{name}")


class StoredTables(Tables):
    """``Tables`` over a store written by ``store_marketplace``; ``raw`` still
    reads the source folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, base: str):
        super().__init__(spark, sf_dir)
        self.base = base.rstrip("/")
        for name in DIMENSIONS:
            self.__dict__[name] = spark.read.parquet(f"{self.base}/{name}")
        for name in FACTS_BY_MONTH:
            self.__dict__[name] = spark.read.parquet(f"{self.base}/{name}").drop("ym")

    def fact_months(self, name: str, first: str, last: str) -> DataFrame:
        """A fact table restricted to the months first..last (partition pruning)."""
        return read_months(self.spark, f"{self.base}/{name}", first, last).drop("ym")
