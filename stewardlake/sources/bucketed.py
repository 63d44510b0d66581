"""Tables that a batch changes only where it has to (S5 with M2-M8).

A table is partitioned into ``parts`` by a hash of its key and bucketed on the
key inside each. A batch of changes is applied to the parts that hold rows it
names: these are read, changed and written over (dynamic partition overwrite);
the files of all others stay as they are. ``parts`` is a multiple of
``buckets``, so a part's rows are in one bucket, and Spark reads the table as
hash-distributed on the key: joins and aggregates on the key, or on the key and
more columns, need no shuffle of the table.

The key of requests is the requester: W1 groups by (requester, product), and J1
joins the requesters. A requester with a third of all requests is a third of a
bucket's bytes; a table like that takes (requester, product) as its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

PART = "part"


class BucketedTable:
    def __init__(self, spark: SparkSession, name: str, path: str, key: list[str], buckets: int = 8, parts: int = 64):
        if parts % buckets:
            raise ValueError("parts must be a multiple of buckets")
        self.spark, self.name, self.path, self.key = spark, name, path, key
        self.buckets, self.parts = buckets, parts

    def _placed(self, df: DataFrame) -> DataFrame:
        # the hash of Spark's own distribution, so that a part holds rows of one bucket
        return df.drop(PART).withColumn(PART, F.pmod(F.hash(*self.key), F.lit(self.parts)))

    def _tasks(self, placed: DataFrame) -> DataFrame:
        """The rows by key in tasks of Spark's advisory size, however few parts and buckets there are."""
        return placed.hint("rebalance", *self.key)

    def create(self, df: DataFrame) -> BucketedTable:
        placed = self._tasks(self._placed(df))
        (placed.write.format("parquet").mode("overwrite").option("path", self.path).partitionBy(PART)
         .bucketBy(self.buckets, *self.key).sortBy(*self.key).saveAsTable(self.name))
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name).drop(PART)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """Parts of rows that have the key columns."""
        return sorted(r[PART] for r in self._placed(rows.select(*self.key)).select(PART).distinct().collect())

    def change(self, named: DataFrame, by: list[str], fn: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Applies ``fn`` to the parts that hold rows with the ``by`` columns of ``named``; returns these parts.

        ``fn`` makes the new rows of the parts from the old ones, with the same
        columns and without moving a row to another key. A batch of known keys
        opens its parts at once; any other finds them by one scan of ``by``."""
        table = self.spark.table(self.name)
        held = named if set(self.key) <= set(by) else table.select(*self.key, *by).join(named.select(*by).distinct(), by, "left_semi")
        parts = self.parts_of(held)
        if not parts:
            return []
        ensure_checkpoint_dir(self.spark)
        old = table.where(F.col(PART).isin(parts)).drop(PART)
        new = self._placed(fn(old).select(*old.columns)).checkpoint()  # read in full before its files are replaced
        self._overwrite(new)
        left = {r[PART] for r in new.select(PART).distinct().collect()}
        for part in set(parts) - left:  # nothing is left of these
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {part})")
        return parts

    def add(self, rows: DataFrame) -> list[int]:
        """Appends rows to the parts of their keys."""
        placed = self._placed(rows.select(*self.read().columns)).checkpoint()
        parts = self.parts_of(placed)
        old = self.spark.table(self.name).where(F.col(PART).isin(parts))
        self._overwrite(old.unionByName(placed).checkpoint())
        return parts

    def _overwrite(self, new: DataFrame) -> None:
        conf = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(conf)
        self.spark.conf.set(conf, "dynamic")
        try:
            columns = self.spark.table(self.name).columns
            self._tasks(new).select(*columns).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(conf, before)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
