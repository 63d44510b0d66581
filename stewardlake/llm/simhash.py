"""SimHash near-dedup by a binary trie self-join.

Fingerprints: the words of a text (A-Z lower-cased, split at white space) give
shingles of three words; a bit is 1 where over half of the shingles' XXH64
hashes have it. Fingerprints link at ``MAX_BITS`` (3) or fewer differing bits,
and a group is what links connect.

The join walks a binary trie of the distinct fingerprints with itself: it
starts from a node paired with itself, goes down both sides of every pair
together, adds up the bits in which the two paths differ and drops a pair as
soon as they exceed the error budget of its depth.

With one trie and a budget of 3 from the root nothing is dropped in the upper
levels, where every pair of short prefixes is alike. So there are four tries,
over the fingerprints rotated by 0, 16, 32 and 48 bits. Of the four 16-bit
quarters of a linking pair one can start so that, going round, the first j
quarters together differ in at most 3j/4 bits (cycle lemma), so each trie may
prune with a budget of 0 bits in the first quarter, 1 in the second, 2 in the
third and 3 in the last and every link is still met in one of them.

Spark deals the subtries: leaves are shuffled by (rotation, first quarter) and
each task walks its sorted subtries level by level with arrays. A subtrie with
more than ``BLOCK`` leaves is first taken apart by joins, eight bits of depth
at a time, into pairs of smaller nodes, so that no task gets an unbounded one.
What a task returns is a spanning forest of the links it found, at most one
row per leaf, however dense the links are. Components of these links are found
by alternating large-star and small-star steps, with a checkpoint per step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, one_of_each_group, ship_package, with_marks

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Leaves of a subtrie, or of a pair of nodes, that one task walks at once.
BLOCK = 2048
#: Shingles hashed at once, and pairs compared at once.
CHUNK = 1 << 16
PAIRS = 1 << 20
QUARTER = 16
STRIDE = 8


def fingerprint(text: str | None, n_words: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text (no words: 0)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n_words, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK].tolist(), ends[i:i + CHUNK].tolist())]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, more columns, fp): one row per row, ``fp`` as a signed 64-bit number."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *[df.schema[c] for c in more],
                           T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            made = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(made)], names=schema.names)

    ship_package(df.sparkSession)
    return df.select(F.col(id_col), F.col(text_col), *more).mapInArrow(run, schema)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def budget(depth: int) -> int:
    """Differing bits that a pair of nodes may have at this depth."""
    return MAX_BITS * -(-depth // QUARTER) // (64 // QUARTER)


class _Forest:
    """Spanning forest of links between positions 0 to n - 1."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            while True:
                further = self.label[self.label]
                if (further == self.label).all():
                    break
                self.label = further


def walk(keys: np.ndarray, pairs: np.ndarray, depth: int, forest: _Forest) -> None:
    """Walks pairs of trie nodes at one depth down to the leaves.

    ``keys`` are the leaves (unsigned), ``pairs`` rows (a0, a1, b0, b1, bits):
    two nodes as ranges of ``keys``, sorted inside each range, and the bits in
    which they differ so far. Links go to ``forest``.
    """
    while len(pairs):
        a0, a1, b0, b1, bits = pairs.T
        n = (a1 - a0) * (b1 - b0)
        small = (n <= 64) | (depth >= 64)
        _compare(keys, pairs[small], forest)
        a0, a1, b0, b1, bits = pairs[~small].T
        if not len(a0):
            return
        am, bm = _middle(keys, a0, a1, depth), _middle(keys, b0, b1, depth)
        same = (a0 == b0) & (a1 == b1)
        down = np.concatenate([np.stack(x, axis=1) for x in (
            (a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], bits[~same] + 1))])
        depth += 1
        a0, a1, b0, b1, bits = down.T
        alone = (a0 == b0) & (a1 == b1) & (a1 - a0 == 1)
        pairs = down[(a1 > a0) & (b1 > b0) & (bits <= budget(depth)) & ~alone]


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First position of each range whose bit at ``depth`` is 1 (binary search in all ranges at once)."""
    lo, hi, shift = lo.copy(), hi.copy(), np.uint64(63 - depth)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1) == 1
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _compare(keys: np.ndarray, pairs: np.ndarray, forest: _Forest) -> None:
    """Compares the leaves of small node pairs, ``PAIRS`` at a time."""
    if not len(pairs):
        return
    total = np.cumsum((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]))
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + PAIRS, PAIRS)))
    for i, j in zip(cuts, [*cuts[1:], len(pairs)]):
        a0, a1, b0, b1, _ = pairs[i:j].T
        width = b1 - b0
        n = (a1 - a0) * width
        which = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        u, v = a0[which] + at // width[which], b0[which] + at % width[which]
        near = (u != v) & (np.bitwise_count(keys[u] ^ keys[v]) <= MAX_BITS)
        forest.link(u[near], v[near])


def _rows(keys: np.ndarray, rot: np.ndarray, forest: _Forest) -> pa.RecordBatch:
    """Links of a forest as rows (a, b) of fingerprints rotated back."""
    r = rot.astype(np.uint64) * np.uint64(QUARTER)
    fps = np.where(r == 0, keys, (keys >> r) | (keys << ((np.uint64(64) - r) % np.uint64(64)))).view(np.int64)
    linked = np.flatnonzero(forest.label != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[forest.label[linked]])], names=["a", "b"])


def _whole_groups(batches, n_keys: int):
    """Arrays of the columns, cut so that rows with equal first ``n_keys`` columns stay together."""
    held = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) < CHUNK:
            continue
        last = np.logical_or.reduce([x != x[-1] for x in held[:n_keys]])
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _bounds(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows, and the end."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), n)


def _join_subtries(batches):
    """Self-join of every subtrie; rows (rot, top, rest) sorted, ``rest`` being the key."""
    for rot, top, rest in _whole_groups(batches, 2):
        keys = rest.view(np.uint64)
        at = _bounds(rot, top)
        a, b = at[:-1], at[1:]
        many = b - a > 1
        forest = _Forest(len(keys))
        walk(keys, np.stack((a, b, a, b, np.zeros_like(a)), axis=1)[many], QUARTER, forest)
        yield _rows(keys, rot, forest)


def _join_pairs(batches):
    """Joins the two nodes of each pair; rows (rot, depth, bits, pair, side, key) sorted."""
    for rot, depth, bits, pair, side, key in _whole_groups(batches, 4):  # both sides of a pair
        keys = key.view(np.uint64)
        forest = _Forest(len(keys))
        at = _bounds(rot, depth, bits, pair, side)
        a, b = at[:-1], at[1:]
        one = side[a] == 2
        nodes = [np.stack((a, b, a, b, bits[a].astype(np.int64)), axis=1)[one & (b - a > 1)]]
        left = np.flatnonzero(side[a] == 0)
        nodes.append(np.stack((a[left], b[left], a[left + 1], b[left + 1], bits[a[left]].astype(np.int64)), axis=1))
        for d in np.unique(depth):
            for x in nodes:
                walk(keys, x[depth[x[:, 0]] == d], int(d), forest)
        yield _rows(keys, rot, forest)


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth < 64 else key


def trie_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what the distinct fingerprints ``fp`` within ``MAX_BITS`` bits connect."""
    turned = [F.struct(F.lit(r).alias("rot"), (F.col("fp") if r == 0 else F.shiftleft("fp", QUARTER * r).bitwiseOR(
        F.shiftrightunsigned("fp", 64 - QUARTER * r))).alias("key")) for r in range(64 // QUARTER)]
    leaves = (fps.select(F.explode(F.array(*turned)).alias("x")).select("x.rot", "x.key")
              .withColumn("top", _prefix(F.col("key"), QUARTER)))
    # Signed keys with equal top bits sort like unsigned ones.
    big = cut_lineage(leaves.groupBy("rot", "top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block))
    if big.isEmpty():
        return _walked(leaves)
    hot = cut_lineage(leaves.join(big.drop("n"), ["rot", "top"], "left_semi"))
    return _walked(leaves.join(big.drop("n"), ["rot", "top"], "left_anti")).unionByName(_taken_apart(hot, block))


def _walked(leaves: DataFrame) -> DataFrame:
    # Between subtries the order is free; inside one the top bits agree, so signed order is trie order.
    dealt = leaves.repartition("rot", "top").sortWithinPartitions("rot", "top", "key").select("rot", "top", "key")
    return dealt.mapInArrow(_join_subtries, "a long, b long")


def _taken_apart(leaves: DataFrame, block: int) -> DataFrame:
    """Links inside large subtries: pairs of nodes are refined by joins until a pair has at most ``block`` leaves."""
    def nodes(depth):
        return leaves.groupBy("rot", _prefix(F.col("key"), depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))

    pairs = nodes(QUARTER).select("rot", F.col("node").alias("a"), F.col("node").alias("b"),
                                  F.lit(0).alias("bits"), F.col("n").alias("na"), F.col("n").alias("nb"))
    out, depth = None, QUARTER
    while True:
        leaves_of = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        ready = pairs.where((leaves_of <= block) & ~((F.col("a") == F.col("b")) & (F.col("na") == 1)))
        rows = ready.select("rot", F.lit(depth).alias("depth"), "bits", F.xxhash64("a", "b").alias("pair"), "a", "b")
        sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(2).alias("side"), F.col("a").alias("node")))
                       ).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")),
                                           F.struct(F.lit(1).alias("side"), F.col("b").alias("node"))))
        rows = rows.withColumn("x", F.explode(sides)).select("rot", "depth", "bits", "pair", "a", "b", "x.side", "x.node")
        at = leaves.select("rot", _prefix(F.col("key"), depth).alias("node"), "key")
        rows = rows.join(at, ["rot", "node"]).select("rot", "depth", "bits", "pair", "a", "b", "side", "key")
        out = rows if out is None else out.unionByName(rows)
        open_ = pairs.where(leaves_of > block)
        if depth == 64 or open_.isEmpty():
            break
        depth += STRIDE
        below = nodes(depth).withColumn("up", F.shiftrightunsigned("node", STRIDE))
        left = below.select("rot", F.col("up").alias("a"), F.col("node").alias("ca"), F.col("n").alias("nca"))
        right = below.select("rot", F.col("up").alias("b"), F.col("node").alias("cb"), F.col("n").alias("ncb"))
        apart = F.col("bits") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << STRIDE) - 1)))
        pairs = cut_lineage(
            open_.select("rot", "a", "b", "bits").join(left, ["rot", "a"]).join(right, ["rot", "b"])
            .where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))).withColumn("bits", apart)
            .where(F.col("bits") <= budget(depth))
            .select("rot", F.col("ca").alias("a"), F.col("cb").alias("b"), "bits", F.col("nca").alias("na"),
                    F.col("ncb").alias("nb")))
    keys = ["rot", "depth", "bits", "a", "b"]
    dealt = (out.repartition(*keys).sortWithinPartitions("rot", "depth", "bits", "pair", "a", "b", "side", "key")
             .select("rot", "depth", "bits", F.xxhash64("a", "b").alias("pair"), "side", "key"))
    return dealt.mapInArrow(_join_pairs, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): ``root`` is the smallest node it is connected to.

    Alternating large-star and small-star steps; each is aggregates and joins
    on nodes and leaves one row per link at most. Skewed joins are split by
    Spark's adaptive execution; the state is checkpointed after each round.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        sums = [x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % (1 << 30))).first() for x in (edges, new)]
        edges = new
        if sums[0] == sums[1]:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: (doc_id, fp, component_id).

    ``component_id`` is the smallest id that links reach. Texts without words,
    null ones too, have fingerprint 0 and link like any other; rows that repeat
    an id are separate rows of the same id; null ids count only where a group
    has no other. An empty table gives no rows; other columns are not looked at.
    """
    return _groups(cut_lineage(fingerprints(df, id_col, text_col)), block).select("doc_id", "fp", "component_id")


def _groups(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """``table`` with ``root`` (one for each group) and ``component_id``."""
    classes = cut_lineage(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(trie_links(classes.select("fp"), block))
    rooted = (classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(groups, "root").select("fp", "root", "component_id")
    return table.join(named, "fp")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each group, with its columns: one with the group's smallest id, the same in every run.

    Rows of other groups that repeat its id, or have none either, are not touched.
    """
    marked, marks = with_marks(df)
    judged = _groups(cut_lineage(fingerprints(marked, id_col, text_col, *marks)))
    judged = judged.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return one_of_each_group(marked, marks, judged, ["root"], "kept")
