"""Building blocks shared by the pipeline operators."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: White space of every contract here: space and U+0009 to U+000D, nothing else.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by the session, so that a
    lost executor re-reads the files instead of recomputing the texts."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once per application.

    Spark serves the archive from the driver, so executors need no shared folder
    for it. Only the package's own code is in it, never data.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), os.path.basename(package)), "zip",
                               os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(app)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it has no more than so many (narrow) rows; counts it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal non-space runs of a text (null: none)."""
    return F.filter(F.split(text_or_empty(text), SPACES), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often (or deep inside lambdas) it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def same_key(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of key columns in which two nulls are equal."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few fixed rows, as one literal of the plan (no Python on the executors)."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ': ').replace(',:', ',')}>>")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def hashable(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that hashes to the same number only if it is the same, nulls and their places included.

    Hash functions of Spark skip nulls, and refuse maps: maps become the sorted hashes of their entries."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.xxhash64(
            hashable(e["key"], kind.keyType), hashable(e["value"], kind.valueType)))
        return F.struct(value.isNull(), F.array_sort(entries))
    if isinstance(kind, T.ArrayType):
        return F.struct(value.isNull(), F.size(value), F.transform(value, lambda x: hashable(x, kind.elementType)))
    if isinstance(kind, T.StructType):
        return F.struct(value.isNull(), *[hashable(value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.VariantType):
        return F.struct(value.isNull(), F.to_json(value))
    return F.struct(value.isNull(), value)


def with_marks(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two hashes (128 bits) of each row's columns, and their names: only equal rows share them."""
    names = [fresh(df, "_mark_a"), fresh(df, "_mark_b")]
    values = [hashable(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.withColumns({n: F.xxhash64(F.lit(k), *values) for k, n in enumerate(names)}), names


def one_of_each_group(df: DataFrame, marks: list[str], judged: DataFrame, groups: list[str], first: str) -> DataFrame:
    """One row of ``df`` (which has the ``marks``) for each group, without the marks.

    ``judged`` has a row for each row of ``df``: its marks, its group and
    whether it may stay (``first``). Of those the one with the least marks
    stays. Equal rows have equal marks; if they win, one of them stays, and
    only then the texts of these rows are shuffled once more.
    """
    alike = cut_lineage(judged.groupBy(*groups, *marks).agg(F.count(F.lit(1)).alias("_n"), F.max(first).alias("_first")))
    best = (alike.where("_first").groupBy(*groups).agg(F.min(F.struct(*marks, "_n")).alias("_best"))
            .select(*[F.col(f"_best.{m}").alias(m) for m in marks], F.col("_best._n").alias("_best_n")))
    lost = cut_lineage(alike.select(*marks).join(best, marks, "left").where("_best_n IS NULL OR _best_n > 1"))
    out = df.join(lost.select(*marks), marks, "left_anti").select(*df.columns)
    repeated = lost.where("_best_n > 1").select(*marks)
    if not repeated.isEmpty():
        out = out.unionByName(df.join(repeated, marks, "left_semi").select(*df.columns).dropDuplicates(marks))
    return out.drop(*marks)


def running_totals(df: DataFrame, groups: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same group up
    to and including this one in ``order``, without one task per group.

    Rows are range-sorted on (groups, order), so that a group with a third of
    all rows spans many partitions, and checkpointed, which fixes each row's
    partition. Totals inside a partition are a window over (partition, group);
    what earlier partitions hold of the group comes from a table with one row
    per (partition, group).
    """
    keys = [F.col(c) for c in groups + order]
    staged = cut_lineage(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (staged.groupBy("_part", *groups).agg(F.sum(value).alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum"))
    here = staged.withColumn("_inside", F.sum(value).over(inside))
    return (here.join(offsets, same_key(here, offsets, "_part", *groups), "left")
            .select(*[here[c] for c in df.columns], (F.col("_inside") + F.col("_before")).alias(name)))
