"""Sharding by a consistent-hash ring with virtual nodes and bounded loads [DataFrame operations only].

The ring has ``SLOTS`` positions. Each shard owns ``VNODES`` virtual nodes at
hashed positions; a document's home is the first virtual node clockwise from
the hash of its id. A shard holds at most its capacity, ``load_factor`` times
the mean number of documents; documents that overflow a full shard continue
clockwise to the next virtual node whose shard has room.

Who overflows depends only on how many documents each arc of the ring holds.
So the arcs are counted in one aggregate (at most shards x ``VNODES`` rows, a
size fixed by parameters), the walk around the ring is done on these counts
and gives segments (arc, ranks, shard), and every document finds its segment
by its rank inside its arc. No document is moved step by step. The ranks come
from a range sort in which even rows of one id and text are told apart by their
place in the table, so an arc, or an id with a third of all rows, is spread
over many tasks.

With ``load_factor`` 1 the capacities are the two integers next to the mean,
so that document counts differ by one at most; a larger factor moves fewer
documents from home.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, running_totals, small_table, text_or_empty

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
VNODES = 64


def ring(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(slot, shard) of all virtual nodes, clockwise. A taken slot passes a node on to the next free one."""
    if n_shards * vnodes > SLOTS // 4:
        raise ValueError(f"at most {SLOTS // 4} virtual nodes")
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"shard {shard} node {v}".encode()).digest()[:8], "big") % SLOTS
            while at in taken:
                at = (at + 1) % SLOTS
            taken[at] = shard
    return sorted(taken.items())


def arc_slots(nodes: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(arc, home shard, first slot, last slot): the slots that lead to each node, the first node's in two rows."""
    out, first = [], 0
    for arc, (slot, shard) in enumerate(nodes):
        out.append((arc, shard, first, slot))
        first = slot + 1
    return out + ([(0, nodes[0][1], first, SLOTS - 1)] if first < SLOTS else [])


def capacities(n: int, n_shards: int, load_factor: float = 1.0) -> list[int]:
    if load_factor <= 1:
        return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    return [math.ceil(load_factor * n / n_shards)] * n_shards


def segments(nodes: list[tuple[int, int]], counts: list[int], caps: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot in the shard) for all documents.

    First each shard fills with its own arcs in ring order, then what is over
    walks clockwise from its arc to shards with room.
    """
    load, out, over = [0] * len(caps), [], []
    for arc, ((_, shard), n) in enumerate(zip(nodes, counts, strict=True)):
        here = min(n, caps[shard] - load[shard])
        if here:
            out.append((arc, 0, here, shard, load[shard]))
            load[shard] += here
        if here < n:
            over.append((arc, here, n))
    for arc, rank, n in over:
        step = arc
        while rank < n:
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            here = min(n - rank, caps[shard] - load[shard])
            if here > 0:
                out.append((arc, rank, rank + here, shard, load[shard]))
                load[shard] += here
                rank += here
    return out


def assign_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                  vnodes: int = VNODES, load_factor: float = 1.0) -> DataFrame:
    """One row per row of ``df``: (doc_id, size, text_crc32, shard, slot, home_shard).

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``slot`` numbers a
    shard's documents from 0 without gaps. Null ids hash like one id. Rows that
    repeat an id are separate documents, ordered by text checksum and size. An
    empty table gives no rows; other columns are not looked at.
    """
    nodes = ring(n_shards, vnodes)
    spark = df.sparkSession
    # Two tables of the ring, bounded by its parameters: the arc of each slot, the segments of each arc.
    arcs = F.broadcast(small_table(spark, arc_slots(nodes), "arc int, home int, first int, last int").select(
        F.explode(F.sequence("first", "last")).alias("ring_slot"), "arc", "home"))
    at = F.xxhash64(F.col(id_col).cast("string"))
    ring_slot = F.shiftrightunsigned(at, 64 - SLOT_BITS).cast("int")
    text = text_or_empty(F.col(text_col))
    placed = cut_lineage(df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), at.alias("at"), ring_slot.alias("ring_slot")).join(arcs, "ring_slot")
        .drop("ring_slot").withColumns({"row": F.monotonically_increasing_id(), "one": F.lit(1)}))
    found = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [found.get(a, 0) for a in range(len(nodes))]
    parts = segments(nodes, counts, capacities(sum(counts), n_shards, load_factor))
    plan = F.broadcast(small_table(spark, parts, "arc int, first bigint, end bigint, shard int, base bigint"))
    ranked = running_totals(placed, ["arc"], ["at", "doc_id", "text_crc32", "size", "row"], "one", "nth").withColumn("rank", F.col("nth") - 1)
    own = (ranked["arc"] == plan["arc"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    return ranked.join(plan, own, "inner").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("first")).alias("slot"),
        F.col("home").alias("home_shard"))
