"""Shared distributed building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Rows of a table in one task that makes many rows of each.
ROWS_IN_TASK = 10_000


def fixed(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: Column, rows_in_task: int | None = None) -> DataFrame:
    """The rows in tasks of about ``rows_in_task`` rows, those of one ``key`` in one task. A file of small rows is read
    by few tasks, however many rows are then made of each."""
    return df.repartition(tasks_for(df.count(), rows_in_task or ROWS_IN_TASK), key)


def tasks_for(rows: int, rows_in_task: int) -> int:
    return max(1, -(-rows // rows_in_task))


def sequence_numbers(df: DataFrame, order_cols: list[str], name: str = "seq") -> DataFrame:
    """Consecutive 1-based numbers in ``order_cols`` order, computed without
    moving all rows into one partition.

    Rows are range-partitioned on the key and checkpointed (so a recomputed
    or lost partition cannot change the partitioning), numbered inside each
    partition, and shifted by the row count of all earlier partitions. The
    offset table has one row per partition, so broadcasting it is bounded by
    the partition count, not by the data.
    """
    ensure_checkpoint_dir(df.sparkSession)
    staged = df.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = staged.withColumn("_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        local.join(F.broadcast(offsets), "_pid", "inner")
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_pid", "_rn", "_off")
    )


def latest_per_key(df: DataFrame, key: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """Fold several changes per key to the last one by ``order`` (max over an
    ordered struct: partial aggregation before the shuffle, skew-safe)."""
    k = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in payload])
    return df.groupBy(*key).agg(F.max(k).alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in payload])
