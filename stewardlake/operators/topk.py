"""Exact top-k of products by shared words, without pairing word sets with all products.

Product ids are cut into blocks of ``FAN`` ids, these into nodes of ``FAN``
blocks, and so on. For every level the postings say which words occur under
which node, so the weights of a set's words that occur there bound the score of
every product below. The search goes down from the top nodes, best bound first
(equal bounds: smaller ids first, as equal scores go by product id), a few
nodes of every word set a round. A set is done when each node it has left is
bounded by less than its k-th product, or by as much but has larger ids only.

A word in a third of the products so costs a set about one path to a block, not
a third of the products. Weights are decimals, so that sums of the same words
are equal in any order and ties are ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed

#: Ids in a block, and children of a node.
BITS = 6
FAN = 1 << BITS
WEIGHT = "decimal(28,9)"


def node(product_id: Column | str, level: int) -> Column:
    return F.shiftright(product_id, BITS * (level + 1))


class Postings:
    """(word, product_id) with their blocks, and which words occur under the nodes of each level."""

    def __init__(self, product_words: DataFrame):
        self.rows = fixed(product_words.select("word", F.col("product_id").cast("long").alias("product_id"), node("product_id", 0).alias("node")))
        self.nodes = [fixed(self.rows.select("word", "node").distinct())]
        while self.nodes[-1].select("node").distinct().limit(FAN + 1).count() > FAN:
            self.nodes.append(fixed(self.nodes[-1].select("word", F.shiftright("node", BITS).alias("node")).distinct()))


def _bounds(asked: DataFrame, under: DataFrame, level: int) -> DataFrame:
    """(set_id, level, node, bound): most that a product below each node can score."""
    return asked.join(under, "word").groupBy("set_id", "node").agg(F.sum("w").cast(WEIGHT).alias("bound")).select(
        "set_id", F.lit(level).alias("level"), "node", "bound")


def _first_id() -> Column:
    """The smallest id below a node."""
    return F.expr("node * shiftleft(1L, %d * (level + 1))" % BITS)


def top_products(asked: DataFrame, postings: Postings, k: int, formed: list[int] | None = None) -> DataFrame:
    """(set_id, product_id, score, shared_words, rank) of the best ``k`` products of each word set.

    ``asked`` has the different words of each set, (set_id, word, w) with positive weights. ``formed`` gets the
    number of (set, product) pairs that were scored in each round."""
    asked = fixed(asked.select("set_id", "word", F.col("w").cast(WEIGHT).alias("w")))
    by_rank = Window.partitionBy("set_id").orderBy(F.desc("score"), F.asc("product_id"))
    by_bound = Window.partitionBy("set_id").orderBy(F.desc("bound"), F.asc("first_id"), F.desc("level"))
    top = len(postings.nodes) - 1
    frontier = _bounds(asked, postings.nodes[top], top)
    best, take = None, 1
    while True:
        open_ = frontier.withColumn("first_id", _first_id())
        if best is not None:
            last = best.where(F.col("rank") == k).select("set_id", F.col("score").alias("least"), F.col("product_id").alias("last_id"))
            open_ = open_.join(last, "set_id", "left").where(
                F.col("least").isNull() | (F.col("bound") > F.col("least"))
                | ((F.col("bound") == F.col("least")) & (F.col("first_id") < F.col("last_id")))).drop("least", "last_id")
        ranked = fixed(open_.withColumn("turn", F.row_number().over(by_bound)))
        chosen = ranked.where(F.col("turn") <= take)
        levels = [r["level"] for r in chosen.select("level").distinct().collect()]
        if not levels:
            break
        words = chosen.select("set_id", "level", "node").join(asked, "set_id")
        frontier = ranked.where(F.col("turn") > take).select("set_id", "level", "node", "bound")
        for level in levels:
            here = words.where(F.col("level") == level)
            if level:
                below = postings.nodes[level - 1].withColumn("parent", F.shiftright("node", BITS))
                children = here.withColumnRenamed("node", "parent").join(below, ["word", "parent"])
                frontier = frontier.unionByName(children.groupBy("set_id", "node").agg(F.sum("w").cast(WEIGHT).alias("bound")).select(
                    "set_id", F.lit(level - 1).alias("level"), "node", "bound"))
                continue
            scored = here.join(postings.rows, ["word", "node"]).groupBy("set_id", "product_id").agg(
                F.sum("w").cast(WEIGHT).alias("score"), F.count(F.lit(1)).alias("shared_words"))
            if formed is not None:
                formed.append(scored.count())
            both = scored if best is None else scored.unionByName(best.drop("rank"))
            best = fixed(both.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k))
        take = min(2 * take, FAN)
    if best is None:
        best = asked.select("set_id", F.lit(0).cast("long").alias("product_id"), F.col("w").alias("score"),
                            F.lit(0).cast("long").alias("shared_words"), F.lit(0).alias("rank")).where(F.lit(False))
    return best
