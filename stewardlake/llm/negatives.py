"""Hard negatives of anchors, mined from lists that the anchors of a cluster share.

An anchor's positives are the other rows of its label with the highest inner
products; a positive's hard negatives are the rows of other labels that score
highest without coming nearer than ``MOST`` percent of the positive's score, and
not less than ``LEAST`` percent of it.

Anchors are clustered by angle. For a cluster with centroid c whose members lie
within the angle b of it, a row at the angle t from c scores at most
norm * cos(max(0, t - b)) against a member of norm 1. The rows sorted by this
bound are the list that all members share. A member walks it from the top and
stops when the bound, times its own norm, is under what it has already: its
k-th positive, or the last negative it still wants. From there no row can enter
its result, whatever its score.

Spark deals each row once, into a segment of at most about ``SEGMENT`` rows near
the same centroid; a cluster's list is the segments' lists. Members first walk
the segment they stand in, which gives them a limit to stop at, and then are
sent only to segments whose best bound for their cluster reaches it. Each visit
gives at most k rows a member, which are merged by rank. A segment's visitors
are split into groups of about ``VISITORS``. So no task grows with the data, and
all rows are compared that have to be: centroids (at most ``CLUSTERS``, fitted on
at most ``SAMPLE`` anchors) decide where rows lie and how early walks end, never
what is found.

Scores are exact: components are integers, products up to 2^53 are taken in
doubles and larger ones in integers of any size, kept within the range of long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut_lineage, ship_package

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95
SAMPLE = 4096
CLUSTERS = 64
SEGMENT = 32_768
VISITORS = 32_768
#: Rows of a list that a walk takes at first; each further step takes four times as many.
STEP = 1024
#: Members that walk side by side.
TOGETHER = 128
EXACT = float(2**53)
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """No null component, none that is not finite (or too large to be squared and summed)."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e140))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int = 0) -> np.ndarray:
    """Integer components as doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = max(dim, int(sizes.max(initial=0)))
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < sizes[:, None]] = np.floor(SCALE * flat)
    return out


def _widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    top = (np.abs(x).max(axis=1, initial=0) for x in (a, b))
    big_a, big_b = (t * t * a.shape[1] >= EXACT for t in top)
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.nan_to_num(a @ b.T, posinf=0, neginf=0)
    if not (big_a.any() or big_b.any()):
        return out.astype(np.int64)
    out = np.clip(out, -2.0**62, 2.0**62).astype(np.int64)
    rows, cols = np.nonzero(big_a[:, None] | big_b[None, :])
    whole_a = {i: [int(x) for x in a[i]] for i in np.unique(rows)}
    whole_b = {j: [int(x) for x in b[j]] for j in np.unique(cols)}
    for i, j in zip(rows.tolist(), cols.tolist()):
        out[i, j] = max(-LONG, min(LONG, sum(x * y for x, y in zip(whole_a[i], whole_b[j]))))
    return out


def _unit(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and norms; a zero vector has the direction zero."""
    top = np.abs(a).max(axis=1, initial=0, keepdims=True)
    small = a / np.where(top > 0, top, 1)
    norm = np.sqrt((small * small).sum(axis=1, keepdims=True))
    return small / np.where(norm > 0, norm, 1), (norm * top)[:, 0]


def _angles(directions: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.matmul(*(lambda u, c: (u, c.T))(*_widened(directions, centroids))), -1, 1))


def fit_centroids(vectors: np.ndarray, seed: int = 0) -> np.ndarray:
    """Directions of clusters by spherical k-means; as many as the root of the number of vectors, halved."""
    unit, norm = _unit(vectors)
    unit = unit[norm > 0]
    if not len(unit):
        return np.zeros((1, max(1, vectors.shape[1])))
    k = int(min(CLUSTERS, max(1, np.sqrt(len(unit)) / 2)))
    centres = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False)]
    for _ in range(8):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        moved, length = _unit(sums)
        centres = np.where(length[:, None] > 0, moved, centres)
    return centres


def bounds(angles: np.ndarray, norms: np.ndarray, width: np.ndarray | float) -> np.ndarray:
    """Most that rows can score against a member of norm 1, a little above the truth."""
    return norms * np.cos(np.maximum(0, angles - width - 1e-7)) + norms * 1e-9 + 1e-6


def _steps(n: int):
    at, size = 0, STEP
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, size * 4


def _reach(bound: float, norms: np.ndarray) -> np.ndarray:
    top = bound * norms
    return np.where(top >= 0, top * (1 + 1e-9) + 1e-6, top * (1 - 1e-9) + 1e-6)


class _List:
    """A cluster's list of a segment: rows by falling bound."""

    def __init__(self, rows: dict[str, np.ndarray], bound: np.ndarray):
        order = np.argsort(-bound, kind="stable")
        self.bound = bound[order]
        self.rows = {k: v[order] for k, v in rows.items()}

    def walk(self, members: dict[str, np.ndarray], limits, take):
        """Calls ``take(member, scores, slice)`` for rows that the member's limit doesn't rule out; returns the rows seen."""
        seen = 0
        for at, end in _steps(len(self.bound)):
            going = np.flatnonzero(_reach(self.bound[at], members["norm"]) >= limits)
            if not len(going):
                break
            seen += len(going) * (end - at)
            scores = products(members["vec"][going], self.rows["vec"][at:end])
            for i, row in zip(going.tolist(), scores):
                take(i, row, slice(at, end))
        return seen


def walk_positives(lst: _List, members: dict[str, np.ndarray], limits: np.ndarray, k: int = POSITIVES):
    """For each member its best ``k`` rows of its label that reach its limit: lists of (-score, id, row)."""
    best: list[list[tuple[int, int, int]]] = [[] for _ in members["rid"]]
    limits = limits.astype(np.float64)
    floor = limits.copy()
    rows = lst.rows

    def take(i, scores, part):
        own = (rows["label"][part] == members["label"][i]) & (rows["rid"][part] != members["rid"][i]) & (scores >= limits[i])
        at = np.flatnonzero(own)
        if len(at):
            ids, rids, s = rows["id"][part][at], rows["rid"][part][at], scores[at]
            first = np.lexsort((rids, ids, -s))[:k]
            best[i] = sorted(best[i] + list(zip((-s[first]).tolist(), ids[first].tolist(), rids[first].tolist())))[:k]
            if len(best[i]) == k:
                limits[i] = max(floor[i], -best[i][-1][0])

    lst.walk(members, limits, take)
    return best


def window_of(score: int) -> tuple[int, int]:
    """Least and highest score of a positive's negatives: 50 * p <= 100 * n <= 95 * p."""
    return -(-LEAST * score // 100), MOST * score // 100


def walk_negatives(lst: _List, members: dict[str, np.ndarray], limits: np.ndarray, k: int = NEGATIVES):
    """For each member and each of its positives the best ``k`` rows of other labels in the positive's window."""
    windows = [[window_of(p) for p in ps] for ps in members["positives"]]
    best = [[[] for _ in w] for w in windows]
    limits = limits.astype(np.float64)
    floor = limits.copy()
    rows = lst.rows

    def take(i, scores, part):
        open_ = [j for j, (lo, hi) in enumerate(windows[i]) if lo <= hi]
        if not open_:
            return
        top = max(windows[i][j][1] for j in open_)
        at = np.flatnonzero((rows["label"][part] != members["label"][i]) & (scores >= limits[i]) & (scores <= top))
        if len(at):
            ids, rids, s = rows["id"][part][at], rows["rid"][part][at], scores[at]
            order = np.lexsort((rids, ids, -s))
            ids, rids, s = ids[order], rids[order], s[order]
            for j in open_:
                lo, hi = windows[i][j]
                a = int(np.searchsorted(-s, -hi))
                b = min(a + k, int(np.searchsorted(-s, -lo, side="right")))
                if a < b:
                    best[i][j] = sorted(best[i][j] + list(zip((-s[a:b]).tolist(), ids[a:b].tolist(), rids[a:b].tolist())))[:k]
        limits[i] = max(floor[i], min(-best[i][j][-1][0] if len(best[i][j]) == k else windows[i][j][0] for j in open_))

    lst.walk(members, limits, take)
    return best


PLACED = "rid long, id long, label int, vec array<double>, home int, theta double, norm double"


def _place(centroids: np.ndarray):
    def run(batches):
        for b in batches:
            unit, norm = _unit(_matrix(b.column("vec")))
            angles = _angles(unit, centroids)
            home = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home.astype(np.int32)), pa.array(np.where(norm > 0, angles[np.arange(len(home)), home], 0.0)),
                 pa.array(norm)],
                names=[*b.schema.names, "home", "theta", "norm"])

    return run


def _best_bounds(centroids: np.ndarray, widths: dict[int, float]):
    """Best bound of the rows of each segment for each cluster."""
    def run(batches):
        for b in batches:
            segment = b.column("segment").to_numpy()
            angles = _angles(_unit(_matrix(b.column("vec")))[0], centroids)
            norm = b.column("norm").to_numpy()
            names, which = np.unique(segment, return_inverse=True)
            for c, width in widths.items():
                top = np.full(len(names), -np.inf)
                np.maximum.at(top, which, bounds(angles[:, c], norm, width))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), c, np.int32)), pa.array(top)],
                                                 names=["segment", "cluster", "bound"])

    return run


def _visit(centroids: np.ndarray, widths: dict[int, float], negatives: bool):
    """The members sent to a segment walk their clusters' lists of it."""
    schema = [("anchor", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("rid", pa.int64())]

    def run(segment: pa.Table, visitors: pa.Table) -> pa.Table:
        out: list[list[int]] = [[] for _ in schema]
        if len(segment) and len(visitors):
            vec = _matrix(segment.column("vec"))
            guests = _matrix(visitors.column("vec"))
            vec, guests = _widened(vec, guests)
            unit, norm = _unit(vec)
            angles = _angles(unit, centroids)
            rows = {"vec": vec, **{k: segment.column(k).to_numpy() for k in ("rid", "id", "label")}}
            who = {"vec": guests, **{k: visitors.column(k).to_numpy() for k in ("rid", "label", "norm", "home", "floor")}}
            if negatives:
                who["positives"] = np.empty(len(visitors), dtype=object)
                who["positives"][:] = visitors.column("positives").to_pylist()
            for c in np.unique(who["home"]).tolist():
                lst = _List(rows, bounds(angles[:, c], norm, widths[c]))
                mine = np.flatnonzero(who["home"] == c)
                for at in range(0, len(mine), TOGETHER):
                    m = {k: v[mine[at:at + TOGETHER]] for k, v in who.items()}
                    walk = walk_negatives if negatives else walk_positives
                    for rid, found in zip(m["rid"].tolist(), walk(lst, m, m["floor"])):
                        for place, best in enumerate(found if negatives else [found]):
                            for score, id_, row in best:
                                for column, value in zip(out, (rid, place, -score, id_, row)):
                                    column.append(value)
        return pa.table([pa.array(x, kind) for x, (_, kind) in zip(out, schema)], names=[n for n, _ in schema])

    return run


FOUND = "anchor long, place int, score long, id long, rid long"


class _Search:
    """Rows dealt into segments, and the anchors' way through them."""

    def __init__(self, placed: DataFrame, anchors: DataFrame, centroids: np.ndarray):
        self.centroids = centroids
        counts = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
        segments = {h: -(-n // SEGMENT) for h, n in counts.items()}
        of_home = F.create_map(*[F.lit(x).cast("long") for h in segments for x in (h, segments[h])])
        parts = F.element_at(of_home, F.col("home").cast("long")) if segments else F.lit(1)
        segment = (F.col("home") * (1 << 32) + F.pmod(F.xxhash64("rid"), parts)).cast("long").alias("segment")
        guests = anchors.select("rid")
        n = guests.count()
        self.groups = max(1, -(-n // VISITORS))
        self.rows = placed.select("rid", "id", "label", "vec", "norm", segment)
        group = F.pmod(F.xxhash64(F.lit(1), "rid"), F.lit(self.groups)).cast("int").alias("grp")
        self.anchors = anchors.select("rid", "label", "vec", "norm", "home", segment, group)
        self.widths = {r["home"]: r["w"] for r in anchors.groupBy("home").agg(F.max("theta").alias("w")).collect()}
        best = self.rows.select("segment", "vec", "norm").mapInArrow(
            _best_bounds(centroids, self.widths), "segment long, cluster int, bound double")
        self.best = cut_lineage(best.groupBy("segment", "cluster").agg(F.max("bound").alias("bound")))

    def _visits(self, visitors: DataFrame, negatives: bool) -> DataFrame:
        dealt = self.rows.drop("norm").withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        apart = visitors.select(*[F.col(c).alias(c) for c in visitors.columns])  # rows and visitors have one origin
        pairs = dealt.groupBy("segment", "grp").cogroup(apart.groupBy("segment", "grp"))
        return pairs.applyInArrow(_visit(self.centroids, self.widths, negatives), FOUND)

    def _further(self, anchors: DataFrame) -> DataFrame:
        """Anchors, once for each other segment that can hold what they still want."""
        there = broadcast_if_small(self.best.select(F.col("segment").alias("to"), F.col("cluster").alias("home"), "bound"))
        reach = F.col("bound") * F.col("norm")
        go = anchors.join(there, "home").where((F.col("to") != F.col("segment")) & (reach + F.abs(reach) * 1e-9 + 1e-6 >= F.col("floor")))
        return go.drop("segment", "bound").withColumnRenamed("to", "segment")

    def found(self, anchors: DataFrame, floor: Column, k: int, negatives: bool) -> DataFrame:
        """(anchor, place, score, id, rid, rank): the best ``k`` rows of each anchor and place.

        ``floor`` makes an anchor's limit from ``got``, the least k-th score of its places after the first visit."""
        own = anchors.withColumn("got", F.lit(None).cast("long")).withColumn("floor", floor.cast("double")).drop("got")
        first = cut_lineage(self._visits(own, negatives))
        full = first.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        need = full.groupBy(F.col("anchor").alias("rid")).agg(F.count(F.lit(1)).alias("n_places"), F.min("least").alias("got"))
        wanted = F.size("positives") if negatives else F.lit(1)
        told = anchors.join(need, "rid", "left").withColumn("got", F.when(F.col("n_places") == wanted, F.col("got")))
        told = told.withColumn("floor", floor.cast("double")).drop("got", "n_places")
        every = first.unionByName(self._visits(self._further(told), negatives))
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "rid"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank).

    ``anchor`` says of a row whether it is an anchor. Rows with a null id, label
    or vector, or with a null or non-finite component (or one over 1e140), take no part. Vectors of
    different lengths are compared as if filled up with zeros; an empty one
    scores 0 with every row. Rows that share an id are rows of their own: each
    can be anchor, positive and negative, an anchor is only never its own
    positive. Equal scores go by the smaller id, then by the place in the table.
    A positive without negatives, an anchor without positives and a table
    without anchors give no rows. Other columns of ``rows`` are not looked at.
    """
    spark = rows.sparkSession
    ship_package(spark)
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("vec"),
                        F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    clean = cut_lineage(clean.withColumn("rid", F.monotonically_increasing_id()))
    fixed = clean.select("rid", "id", "label", "vec", "is_anchor")
    sample = fixed.where("is_anchor").orderBy(F.xxhash64("rid"), "rid").limit(SAMPLE).select("vec").toArrow()
    centroids = fit_centroids(_matrix(sample.column("vec"))) if len(sample) else np.zeros((1, 1))
    schema = T._parse_datatype_string(PLACED.replace("vec array<double>", "vec array<double>, is_anchor boolean"))
    placed = cut_lineage(fixed.mapInArrow(_place(centroids), schema))
    search = _Search(placed, placed.where("is_anchor"), centroids)
    anchors = search.anchors
    names = placed.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id")).where("is_anchor")

    any_score = F.coalesce(F.col("got"), F.lit(float("-inf")))
    positives = cut_lineage(search.found(anchors, any_score, POSITIVES, False))
    listed = positives.groupBy(F.col("anchor").alias("rid")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p")).select(
        "rid", F.transform("p", lambda x: x["score"]).alias("positives"))
    seekers = cut_lineage(anchors.join(listed, "rid"))
    # no negative is under half of the least positive that has a window at all
    windows = F.filter("positives", lambda p: p >= 0)
    lowest = F.array_min(F.transform(windows, lambda p: p * (LEAST / 100.0)))
    some = F.when(F.size(windows) > 0, F.greatest(F.coalesce(F.col("got").cast("double"), lowest - 1), lowest - 1)).otherwise(float("inf"))
    negatives = search.found(seekers, some, NEGATIVES, True)
    pairs = negatives.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(chosen, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
        (F.col("place") + 1).alias("positive_rank"))
