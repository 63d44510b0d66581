"""Mixing sources to target weights by weighted fair queueing [DataFrame operations only].

Every source is a queue of its documents in a fixed shuffled order (MD5 of
seed and id), served up to ``REPEATS`` times over. A copy's virtual finish
time is the number of words its source has served up to and including it,
divided by the source's target. All copies are range-sorted by finish time and
the mix is what comes before the total budget is used up. As each source
reaches its target at time 1, every source's share comes within about one
document of its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACES, cut_lineage, fresh, running_totals, same_key, text_or_empty, with_marks

#: Weights dealt to the sources in code-point order, over and over.
WEIGHTS = (5, 2, 1)
#: The mix has this share of all words, and no document more than this often.
BUDGET = 1.5
REPEATS = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(NOT_SPACES)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET,
                   repeats: int = REPEATS) -> DataFrame:
    """(source, srank, source_size, target) from rows (source, size).

    Targets are the budget dealt by weight; a source gets at most ``repeats``
    times its size, and what is above is dealt again by weight to the others
    (water-filling: with the sources ordered by size per weight, the capped
    ones are a prefix). The table has one row per source and its windows run in
    one task: fine for up to some millions of sources.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "srank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("srank") - 1) % len(weights) + 1)
    dealt = (named.withColumn("srank", F.row_number().over(by_name)).withColumn("weight", w)
             .withColumn("most", F.col("source_size") * repeats)
             .withColumn("left", F.sum("source_size").over(every) * F.lit(budget)
                         - F.coalesce(F.sum("most").over(before), F.lit(0)))
             .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
             .withColumn("level", F.col("left") / F.col("open"))
             .withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
             .withColumn("pos", F.row_number().over(fill)))
    first = F.min(F.when(~F.col("full"), F.struct("pos", "level"))).over(every)
    return dealt.withColumn("cut", first).select(
        "source", "srank", "source_size",
        F.when(F.col("cut").isNull() | (F.col("pos") < F.col("cut.pos")), F.col("most").cast("double"))
        .otherwise(F.col("cut.level") * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS,
        seed: str = SEED) -> DataFrame:
    """One row per row of ``df``: (doc_id, source, size, source_size, target, copies, taken).

    ``copies`` (0 to ``repeats``) is how often the mix takes the document,
    ``taken`` the words of these copies. Null texts have size 0; null sources
    are one source, the last; documents of size 0 come with their neighbours in
    the queue and take nothing. Rows that repeat an id are queued by size and by a
    checksum of their texts; only rows of one id, text and source are alike, and
    of these it is open which one is taken, not how many. A table without words
    takes nothing.
    """
    return _mix(df, id_col, text_col, source_col, weights, budget, repeats, seed, [])


def _mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], budget: float,
         repeats: int, seed: str, more: list[str]) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    slim = cut_lineage(df.select(
        *more, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), key)).alias("turn"), F.left(F.md5(text_or_empty(F.col(text_col))), F.lit(16)).alias("mark")))
    targets = cut_lineage(source_targets(slim.select("source", "size"), weights, budget, repeats))
    queued = running_totals(slim, ["source"], ["turn", "doc_id", "size", "mark", *more], "size", "served")
    timed = (queued.join(targets, same_key(queued, targets, "source"), "left")
             .drop(targets["source"]).where(F.col("srank").isNotNull()))
    timed = cut_lineage(timed)
    copies = timed.where("target > 0").select(
        "srank", "turn", "doc_id", "size", "mark",
        F.posexplode(F.array(*[(F.col("served") + F.col("source_size") * i) / F.col("target") for i in range(repeats)]))
        .alias("copy", "finish"))
    order = ["finish", "srank", "turn", "doc_id", "size", "mark", "copy"]
    total = slim.agg(F.sum("size")).first()[0] or 0
    lined = running_totals(copies, [], order, "size", "used")
    # The budget's end is one row: every copy up to it in the order is taken.
    last = lined.where(F.col("used") <= F.lit(total * budget)).agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    if last is None:
        count = F.lit(0)
    else:
        end = F.struct(*[F.lit(last[c]).cast(copies.schema[c].dataType).alias(c) for c in order])
        count = F.lit(0)
        for i in range(repeats):
            at = F.struct(((F.col("served") + F.col("source_size") * i) / F.col("target")).alias("finish"),
                          "srank", "turn", "doc_id", "size", "mark", F.lit(i).alias("copy"))
            count = count + F.when((F.col("target") > 0) & (at <= end), 1).otherwise(0)
    return timed.select(*more, "doc_id", "source", "size", "source_size", "target", count.cast("long").alias("copies"),
                        (F.col("size") * count).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row of ``df`` as often as the mix takes it.

    Rows are told apart by all their columns, so those that repeat an id (or
    have none) come as often as the mix takes each. Equal rows together come
    as often as it takes them together. No rows give no rows.
    """
    marked, marks = with_marks(df)
    nth, n = fresh(df, "_copy"), fresh(df, "_copies_each")
    mixed = _mix(marked, id_col, text_col, source_col, WEIGHTS, BUDGET, REPEATS, SEED, marks)
    taken = cut_lineage(mixed.groupBy(*marks).agg(F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")).where("all > 0"))
    # What equal rows get is dealt evenly; what is over comes from one of them.
    each = taken.select(*marks, F.expr("cast(all div rows as int)").alias(n)).where(F.col(n) > 0)
    over = taken.select(*marks, (F.col("all") % F.col("rows")).cast("int").alias(n)).where(F.col(n) > 0)
    out = marked.join(each, marks).select(*marked.columns, n)
    if not over.isEmpty():
        one = marked.join(over, marks, "left_semi").select(*marked.columns).dropDuplicates(marks)
        out = out.unionByName(one.join(over, marks).select(*marked.columns, n))
    return out.select(*df.columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(nth)).drop(nth)
