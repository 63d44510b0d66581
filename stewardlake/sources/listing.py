"""Metadata listings with hashes by level, and what changed between two.

A listing holds one row per column, and a hash for every table, schema and
catalog, each made from the hashes of the level below (sums, so the order of
rows does not count and partial aggregates merge). ``changes`` compares two
listings from the top: catalogs by their hash, then the schemas of those that
differ, then the tables of those schemas; only columns of tables that differ
are joined. Tables and columns are partitioned by a hash of the schema, and the
join with the schemas that differ prunes these partitions when it runs: a part
whose schemas are all unchanged is not opened. With at least as many parts as
schemas nearly every part is one schema.

A column listed twice in a table counts once, with the larger type and tags.
Null names are names of their own. Nothing grows on the driver; the largest
group is one table's columns, and sums are folded before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ["catalog_name", "schema_name", "table_name"]
#: Levels from the top; each has the names down to its own.
LEVELS = {"catalogs": NAMES[:1], "schemas": NAMES[:2], "tables": NAMES}
CHANGED = [*NAMES, "column_name", "change", "old_type", "new_type", "old_tags", "new_tags"]


def _key(names: list[str]) -> Column:
    """A key without nulls for ``names`` that may be null."""
    return F.md5(F.to_json(F.array(*[F.col(n).cast("string") for n in names])))


def _hash(*cols: str) -> Column:
    """A hash in which a null differs from an absent column."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.col(c))])


def _total(h: Column) -> Column:
    return F.sum(h.cast("decimal(20,0)"))


def column_listing(meta_tables: DataFrame, columns_with_tags: DataFrame) -> DataFrame:
    """Columns by the names of their table; ``tags`` as JSON sorted by name, null without tags."""
    entries = F.array_sort(F.map_entries("tags"))
    cols = columns_with_tags.select(
        "product_id", "column_name", "data_type", F.when(F.size("tags") > 0, F.to_json(entries)).alias("tags"))
    return meta_tables.select("product_id", *NAMES).join(cols, "product_id").select(*NAMES, "column_name", "data_type", "tags")


class Listing:
    """A listing stored at ``path``, with as many ``parts`` as the listing it is compared with."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.spark, self.path, self.parts = spark, path, parts

    def write(self, columns: DataFrame) -> Listing:
        """Stores ``columns`` (names, column_name, data_type, tags) and the hashes of all levels."""
        part = F.pmod(F.xxhash64(_key(NAMES[:2])), F.lit(self.parts)).cast("int")
        once = columns.groupBy(*NAMES, "column_name").agg(F.max(F.struct("data_type", "tags")).alias("v"))
        rows = once.select(part.alias("part"), _key(NAMES).alias("table_key"), *NAMES, "column_name", "v.data_type", "v.tags")
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(
            f"{self.path}/columns")
        below, h = self._read("columns"), _hash("column_name", "data_type", "tags")
        for level, names in reversed(LEVELS.items()):
            keep = ["part"] if level != "catalogs" else []
            out = below.groupBy(*keep, *names).agg(_total(h).alias("hash")).withColumn("key", _key(names))
            writer = out.write.mode("overwrite")
            (writer.partitionBy("part") if keep else writer).parquet(f"{self.path}/{level}")
            below, h = self._read(level), _hash(names[-1], "hash")
        return self

    def _read(self, what: str) -> DataFrame:
        names = "catalog_name string, schema_name string, table_name string"
        if what == "columns":
            schema = f"part int, table_key string, {names}, column_name string, data_type string, tags string"
        else:
            own = ", ".join(names.split(", ")[:len(LEVELS[what])])
            schema = f"{own}, hash decimal(30,0), key string" + (", part int" if what != "catalogs" else "")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}")


def _differing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys (with their part) whose hash differs or is on one side only."""
    keep = [c for c in ("part",) if c in old.columns]
    sides = old.select("key", *keep, F.col("hash").alias("o"), F.lit(None).cast("decimal(30,0)").alias("n")).unionByName(
        new.select("key", *keep, F.lit(None).cast("decimal(30,0)").alias("o"), F.col("hash").alias("n")))
    return sides.groupBy("key", *keep).agg(F.max("o").alias("o"), F.max("n").alias("n")).filter(
        ~F.col("o").eqNullSafe(F.col("n"))).select("key", *keep)


def _level(old: Listing, new: Listing, level: str) -> DataFrame:
    """Keys of a level that differ; only below keys of the level above that differ."""
    a, b = old._read(level), new._read(level)
    if level == "schemas":
        above = _level(old, new, "catalogs").withColumnRenamed("key", "above")
        a, b = (x.withColumn("above", _key(NAMES[:1])).join(above, "above", "left_semi") for x in (a, b))
    elif level == "tables":
        above = changed_schemas(old, new).withColumnRenamed("key", "above")
        a, b = (x.withColumn("above", _key(NAMES[:2])).join(above, ["part", "above"], "left_semi") for x in (a, b))
    return _differing(a, b)


def changed_schemas(old: Listing, new: Listing) -> DataFrame:
    """The schemas that are opened: their ``key`` and ``part``."""
    if old.parts != new.parts:
        raise ValueError("both listings need the same number of parts")
    return _level(old, new, "schemas")


def changes(old: Listing, new: Listing) -> DataFrame:
    """One row per change of a column: added, dropped, retyped, retagged (a column may be both of the last).

    Equal to a full outer join of the columns; a new or vanished table gives a row for each of its columns."""
    schemas = changed_schemas(old, new).select("part").distinct()
    tables = _level(old, new, "tables").select("part", F.col("key").alias("table_key"))

    def opened(listing: Listing, side: str) -> DataFrame:
        rows = listing._read("columns").join(schemas, "part", "left_semi").join(tables, ["part", "table_key"], "left_semi")
        return rows.select(*NAMES, "column_name", F.struct("data_type", "tags").alias("v"), F.lit(side).alias("side"))

    def of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("v")))

    both = opened(old, "old").unionByName(opened(new, "new")).groupBy(*NAMES, "column_name").agg(
        of("old").alias("o"), of("new").alias("n"))
    kinds = F.array_compact(F.array(
        F.when(F.col("o").isNull(), "added"), F.when(F.col("n").isNull(), "dropped"),
        F.when(F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o.data_type").eqNullSafe(F.col("n.data_type")), "retyped"),
        F.when(F.col("o").isNotNull() & F.col("n").isNotNull() & ~F.col("o.tags").eqNullSafe(F.col("n.tags")), "retagged")))
    return both.select(
        *NAMES, "column_name", F.explode(kinds).alias("change"), F.col("o.data_type").alias("old_type"),
        F.col("n.data_type").alias("new_type"), F.col("o.tags").alias("old_tags"), F.col("n.tags").alias("new_tags"))
