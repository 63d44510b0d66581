"""Exact dedup with a heavy-hitter split [DataFrame operations only].

Texts are equal when they are identical after replacing every run of white
space (space, U+0009 to U+000D) by one space; their SHA-256 stands for them.

A digest shared by very many rows would put all of them into one shuffle
partition. So the digests are split in two:

1. Misra-Gries: one pass of the frequent-items summary (``approx_top_k``, the
   merge-able Misra-Gries summary of Spark) proposes frequent digests. Any
   digest with more than ``rows / TRACKED`` rows is in the summary.
2. Verification: the proposed digests (at most ``HEAVY``, a size fixed by
   parameter) are counted exactly, with partial sums in each task.
3. The verified winners, at most ``HEAVY`` rows, are broadcast: rows that hold
   them get their group's smallest id and size where they are and never
   shuffle. All other digests are shuffled in the ordinary way.

The split only decides which way a row goes; both ways give the same result,
so nothing depends on the summary being right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut_lineage, one_of_each_group, text_or_empty, with_marks

#: Counters of the Misra-Gries summary and digests taken from it at most.
TRACKED = 4096
HEAVY = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id, more columns, text_sha256): the only pass over the texts."""
    return df.select(F.col(id_col), *more, F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))


def heavy_groups(table: DataFrame, id_col: str) -> DataFrame:
    """Verified frequent digests: (text_sha256, keep_id, group_size), at most ``HEAVY`` rows."""
    n = table.count()
    top = table.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {TRACKED})").alias("t")).first()["t"] if n else []
    proposed = [r["item"] for r in top or [] if r["count"] * TRACKED > n and r["count"] > 1]
    return (table.where(F.col("text_sha256").isin(proposed) if proposed else F.lit(False))
            .groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where(F.col("group_size") > 1))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: (id, keep_id, group_size, kept, text_sha256).

    ``keep_id`` is the smallest id of the equal texts. Null texts count as
    empty and equal each other. Rows that repeat an id with an equal text are
    one document: they share the verdict. Null ids are smaller than none: they
    are kept only in a group without any other id. An empty table gives no
    rows; other columns of ``df`` are not looked at.
    """
    return _groups(cut_lineage(digests(df, id_col, text_col)), id_col)


def _groups(table: DataFrame, id_col: str, *more: str) -> DataFrame:
    heavy = F.broadcast(heavy_groups(table, id_col))
    marked = table.join(heavy, "text_sha256", "left")
    own = Window.partitionBy("text_sha256")
    rest = (table.join(heavy, "text_sha256", "left_anti")
            .withColumn("keep_id", F.min(id_col).over(own))
            .withColumn("group_size", F.count(F.lit(1)).over(own)))
    cols = [id_col, *more, "keep_id", "group_size", "text_sha256"]
    both = marked.where(F.col("group_size").isNotNull()).select(*cols).unionByName(rest.select(*cols))
    return both.select(id_col, *more, "keep_id", "group_size",
                       F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group of equal texts, with its columns.

    It has the group's smallest id (see ``exact_groups``); of several such rows
    any one, the same in every run. Rows are told apart by id and text, so that
    repeated and null ids of other texts are not touched.
    """
    marked, marks = with_marks(df)
    judged = _groups(cut_lineage(digests(marked, id_col, text_col, *marks)), id_col, *marks)
    return one_of_each_group(marked, marks, judged, ["text_sha256"], "kept")


