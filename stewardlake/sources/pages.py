"""Pages of a sorted listing by key ranges.

One range sort numbers the rows; they are stored in sort order in parts, beside
a directory with one row per page: its first and last key and the parts it lies
in. A page is one lookup in the directory (one row reaches the driver) and one
read between its keys, pruned to its parts; nothing before the page is read,
sorted or skipped. The directory is one page size smaller than the listing.

The sort columns must give each row a key of its own (the last is an id); null
keys sort first, as in Spark. The store is a version: a changed listing is
written anew. An empty listing has no pages; a page that does not exist is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators.common import sequence_numbers


class PageStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, listing: DataFrame, order: list[str], size: int = rules.PAGE_SIZE, rows_in_part: int = 100_000) -> PageStore:
        """Stores ``listing`` sorted by ``order`` in pages of ``size`` rows."""
        at = F.col("_seq") - 1
        numbered = sequence_numbers(listing, order, "_seq").withColumn("_part", F.expr(f"(_seq - 1) div {rows_in_part}"))
        listing.filter(F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/columns")  # an empty listing has no part
        numbered.drop("_seq").sortWithinPartitions("_part", *order).write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/rows")
        key = F.struct(*order)
        pages = numbered.groupBy((F.floor(at / F.lit(size)) + 1).cast("long").alias("page")).agg(
            F.min(key).alias("first_key"), F.max(key).alias("last_key"),
            F.min("_part").alias("first_part"), F.max("_part").alias("last_part"))
        total = numbered.select(F.ceil(F.max("_seq") / F.lit(float(size))).cast("long")).scalar()
        pages.withColumn("total_pages", total).sort("page").write.mode("overwrite").parquet(f"{self.path}/directory")
        return self

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/directory")

    def total_pages(self) -> int:
        return self.directory().agg(F.coalesce(F.max("page"), F.lit(0)).alias("n")).first()["n"]

    def read(self, page: int) -> DataFrame:
        """The rows of page ``page`` (from 1) with ``page`` and ``total_pages``."""
        schema = self.spark.read.parquet(f"{self.path}/columns").schema.add("_part", "long")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        found = self.directory().filter(F.col("page") == page).first()
        if found is None:
            return rows.filter(F.lit(False)).drop("_part").select("*", F.lit(page).alias("page"), F.lit(0).cast("long").alias("total_pages"))
        first, last = found["first_key"].asDict(), found["last_key"].asDict()
        order = list(first)
        types = {f.name: f.dataType for f in self.directory().schema["first_key"].dataType.fields}

        def bound(values: dict):
            return F.struct(*[F.lit(values[c]).cast(types[c]).alias(c) for c in order])

        hit = F.col("_part").between(found["first_part"], found["last_part"])
        lead = order[0]
        if first[lead] is not None:  # the leading column alone reaches the scan
            hit = hit & F.col(lead).between(F.lit(first[lead]), F.lit(last[lead]))
        hit = hit & (F.struct(*order) >= bound(first)) & (F.struct(*order) <= bound(last))
        return rows.filter(hit).drop("_part").select("*", F.lit(page).alias("page"), F.lit(found["total_pages"]).alias("total_pages"))
