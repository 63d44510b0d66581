"""Merkle manifest of a table, with a witness for every row.

A row's leaf is the SHA-256 of its columns. The leaves of a language, in the
order of their ids, are the first level of a tree: every ``FAN`` consecutive
nodes of a level become their hash, until one node, the subroot, is left. The
subroots, in the order of the languages, are the leaves of the last tree, whose
root names the whole table. A row's witness holds, level by level up to the
root, what stands left and right of its node in the node's run; whoever has the
row and its witness can recompute the root (``fold``).

Witnesses grow while leaves are appended. An open subtree keeps, for each of
its nodes, a partial witness: a node that comes in takes what stands in its run
already as its left part, and adds itself to the right part of those. When a
run is complete the parts are final, go to the leaves below, and the run's hash
is appended one level up.

Spark deals aligned blocks of ``FAN ** HEIGHT`` leaves, so a block is a subtree
of its own and streams through one task. The roots of blocks are leaves of a
further append, and so on until each language has one root: a language with a
third of all rows is many blocks, and every level has 512 times fewer rows than
the level below. Texts are hashed where they are read; only digests are
shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut_lineage, ship_package

FAN = 8
#: Levels of a block.
HEIGHT = 3

WITNESS = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that no two rows have the same fields in a row; null is ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(start: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def siblings(witness: Column) -> Column:
    """The witness' digests in one string, level by level, left to right."""
    return F.concat_ws("", F.transform(witness, lambda s: F.concat(s["left"], s["right"])))


class Witnesses:
    """Append-only tree of at most ``height`` levels; ``of[i]`` is the witness of the i-th digest appended."""

    def __init__(self, height: int = HEIGHT):
        self.of: list[list[tuple[str, str]]] = []
        self.root: str | None = None
        self._height = height
        self._open: list[list[list]] = [[] for _ in range(height + 1)]

    def append(self, node: str) -> None:
        self.of.append([])
        self._attach(0, node, range(len(self.of) - 1, len(self.of)))

    def _attach(self, level: int, node: str, leaves: range) -> None:
        """A new node of a level: the open run stands left of it, and it stands right of the open run."""
        run = self._open[level]
        for earlier in run:
            earlier[2] += node
        run.append([node, "".join(n[0] for n in run), "", leaves])
        if len(run) == FAN and level < self._height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        for _, left, right, leaves in run:
            for i in leaves:
                self.of[i].append((left, right))
        node = hashlib.sha256("".join(n[0] for n in run).encode()).hexdigest()
        self._attach(level + 1, node, range(run[0][3].start, run[-1][3].stop))

    def finish(self, alone: bool) -> str:
        """Completes the open runs. A tree that stands ``alone`` ends as soon as one node is left; a block of a
        larger tree always has all its levels."""
        for level in range(self._height):
            run = self._open[level]
            if alone and len(run) == 1 and not any(self._open[level + 1:]):
                self.root = run[0][0]
                return self.root
            if run:
                self._complete(level)
        self.root = self._open[self._height][0][0]
        return self.root


def _grown(table: pa.Table, height: int) -> tuple[pa.Table, Witnesses]:
    """The nodes of one block in their order, and their witnesses."""
    table = table.sort_by("pos")
    tree = Witnesses(height)
    for node in table.column("node").to_pylist():
        tree.append(node)
    tree.finish(alone=table.column("n")[0].as_py() <= FAN ** height)
    return table, tree


def _block_root(height: int):
    def run(table: pa.Table) -> pa.Table:
        table, tree = _grown(table, height)
        blocks = -(-table.column("n")[0].as_py() // FAN ** height)
        return pa.table({"grp": table.column("grp")[:1], "pos": table.column("block")[:1], "n": pa.array([blocks]),
                         "node": pa.array([tree.root])})

    return run


def _with_witness(height: int):
    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        """Nodes of a block with their witnesses up to the root; ``above`` is the row of the block's root."""
        table, tree = _grown(table, height)
        rest = [(s["left"], s["right"]) for s in above.column("witness")[0].as_py()]
        steps = [own + rest for own in tree.of]
        at = [0]
        for s in steps:
            at.append(at[-1] + len(s))
        parts = pa.StructArray.from_arrays([pa.array([x[k] for s in steps for x in s], pa.string()) for k in (0, 1)],
                                           names=["left", "right"])
        out = table.append_column("witness", pa.ListArray.from_arrays(pa.array(at, pa.int32()), parts))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array(above.column(c).to_pylist() * len(table), pa.string()))
        return out

    return run


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds ``pos``, a row's place (from 0) among the rows of its group, and ``n``, their number.

    Rows are range-sorted, so a group may span many partitions, and
    checkpointed, which fixes the order of equal rows. A partition's first place
    comes from a table with a row for each (partition, group).
    """
    keys = groups + order
    staged = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns(
        {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = staged.groupBy("_part", *groups).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_held"))
    group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keyed = ["_part", *groups]
    starts = cut_lineage(held.select(
        *[F.col(c).alias(f"_k{k}") for k, c in enumerate(keyed)],
        (F.coalesce(F.sum("_held").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_held").over(group).alias("n")))
    alike = F.lit(True)
    for k, c in enumerate(keyed):
        alike = alike & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return staged.join(broadcast_if_small(starts), alike).select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def witnesses(nodes: DataFrame, above=None, height: int = HEIGHT) -> DataFrame:
    """Adds ``witness``, ``subroot`` and ``root`` to nodes (grp, pos, n, node, ...), a tree for each ``grp``.

    ``above`` makes (grp, witness, root) of the groups' subroots (grp, node); without it a group's subroot is its root.
    """
    ship_package(nodes.sparkSession)
    kept = [T.StructField("grp", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("node", T.StringType())]
    block = F.expr(f"pos div {FAN ** height}")
    levels = [nodes.withColumn("block", block)]
    while True:
        most = levels[-1].agg(F.max("n")).first()[0] or 0
        slim = levels[-1].select("grp", "block", "pos", "n", "node")
        roots = cut_lineage(slim.groupBy("grp", "block").applyInArrow(_block_root(height), T.StructType(kept)))
        if most <= FAN ** height:
            break
        levels.append(roots.withColumn("block", block))
    tops = roots.select("grp", F.col("node").alias("subroot"))
    if above is None:
        upper = tops.withColumns({"witness": F.array().cast(WITNESS), "root": F.col("subroot")})
    else:
        upper = tops.join(above(roots.select("grp", "node")).select("grp", "witness", "root"), "grp")
    upper = upper.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        schema = T.StructType([*level.schema, T.StructField("witness", WITNESS), T.StructField("subroot", T.StringType()),
                               T.StructField("root", T.StringType())])
        done = level.groupBy("grp", "block").cogroup(upper.select("grp", "block", "witness", "subroot", "root").groupBy("grp", "block"))
        out = done.applyInArrow(_with_witness(height), schema)
        if k:
            upper = cut_lineage(out.select("grp", F.col("pos").alias("block"), "witness", "subroot", "root"))
    return out.drop("block")


def group_key(group: Column) -> Column:
    """A group's name as a string without nulls, in the order of nulls first, then bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def manifest(leaves: DataFrame, group: str, order: list[str], height: int = HEIGHT) -> DataFrame:
    """Adds ``witness`` (array of left and right siblings), ``subroot`` and ``root`` to the rows of ``leaves``.

    ``leaves`` has a digest ``leaf``. Rows of a group are ordered by ``order``
    (nulls first) and then by their leaf and the other columns, so rows that
    share an id have a fixed order and only equal rows may change places. A null
    group is a group of its own, and the first. A group with one row has no
    siblings, its leaf is the subroot; one group alone has its subroot as root.
    No rows give no rows.
    """
    rest = [c for c in leaves.columns if c not in ("leaf", group, *order)]
    named = leaves.select(group_key(F.col(group)).alias("grp"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)],
                          F.col("leaf").alias("node"), F.col(group).alias("g"),
                          *[F.col(c).alias(f"c{k}") for k, c in enumerate(rest)])
    sort = [f"o{k}" for k in range(len(order))] + ["node"] + [f"c{k}" for k in range(len(rest))]
    placed = numbered(cut_lineage(named), ["grp"], sort)

    def last_tree(subroots: DataFrame) -> DataFrame:
        whole = numbered(subroots.withColumn("name", F.col("grp")), [], ["name"]).withColumn("grp", F.lit(""))
        return witnesses(whole, height=height).select(F.col("name").alias("grp"), "witness", "root")

    out = witnesses(cut_lineage(placed), last_tree, height)
    return out.select(*[F.col(f"o{k}").alias(c) for k, c in enumerate(order)], F.col("g").alias(group),
                      F.col("node").alias("leaf"), *[F.col(f"c{k}").alias(c) for k, c in enumerate(rest)],
                      "witness", "subroot", "root")
