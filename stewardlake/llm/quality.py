"""Quality classifier: interpolated modified Kneser-Ney character n-gram model of trusted text.

Training: trusted documents are those with label 1 in ``labels``. Their
character ``ORDER``-grams are counted in each task and summed by a shuffle;
lower orders, contexts and back-off weights are aggregates and joins of these
counts (all of them grow with the trusted text, nothing is cut or collected
but four counts of counts for each order, which give the discounts).

Scoring: documents are dealt into blocks of about ``BLOCK_CHARS`` characters
and shuffled there once, as compressed packs. A block's different n-grams are
few against its characters; they are joined with the model, which stays sharded
by n-gram, and what the model knows of them goes back to the block, where every
character is scored, one pack after the other. So neither the model nor the
texts' n-grams are ever gathered in one place.

Perplexity is per character, the end of the text included. A document is of
high quality if its perplexity is at most the ``QUANTILE`` quantile of trusted
documents of its language that training has not seen (every fifth by CRC-32 of
the id); languages without any use the quantile over all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, ship_package

ORDER = 5
#: Characters of a block; larger blocks ask the model for the same n-grams less often.
BLOCK_CHARS = 80_000_000
#: Bytes of rows that a task deals into packs at once.
PACK = 1 << 25
QUANTILE = 0.99
HELD_OUT = 5
#: Trusted ids are broadcast up to this many (about 16 MB), and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Characters counted or scored at once.
PART = 1 << 21
START, END = "\x02", "\x03"


def _normal(text: str | None) -> str:
    return " ".join((text or "").replace(START, " ").replace(END, " ").split())


def _normalised(texts) -> pa.Array:
    return pa.array([_normal(t) for t in texts.to_pylist()], pa.string())


def _parts(texts) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
    """(numbers of the texts, joined texts, starts of their n-grams, n-grams of each text) for parts of normalised texts.

    Each text stands between ORDER - 1 start signs and one end sign.
    """
    who, held, n = [], [], 0

    def part():
        sizes = np.array([len(t) for t in held])
        ends = np.cumsum(sizes)
        counts = sizes - (ORDER - 1)
        starts = np.arange(ends[-1])
        drop = np.repeat(ends - (ORDER - 1), ORDER - 1) + np.tile(np.arange(ORDER - 1), len(ends))
        return who, "".join(held), np.delete(starts, drop), counts

    for i, t in enumerate(texts):
        t = t.as_py()
        if not t:
            continue
        who.append(i)
        held.append(START * (ORDER - 1) + t + END)
        n += len(t)
        if n >= PART:
            yield part()
            who, held, n = [], [], 0
    if held:
        yield part()


def _types(joined: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers (hashes) of the different n-grams, where each stands first, and the place of each n-gram among them."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    key = np.zeros(len(starts), dtype=np.uint64)
    for k in range(ORDER):
        key = (key ^ codes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    which, types = pd.factorize(key)
    first = np.zeros(len(types), dtype=np.int64)
    first[which[::-1]] = starts[::-1]
    return types, first, which


def _grams(joined: str, first: np.ndarray) -> list[str]:
    return [joined[s:s + ORDER] for s in first.tolist()]


def _unknown(types: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the numbers are not among the sorted ``keys``."""
    if not len(keys):
        return np.ones(len(types), dtype=bool)
    return keys[np.minimum(np.searchsorted(keys, types), len(keys) - 1)] != types


def gram_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each ``ORDER``-gram occurs in the texts."""
    def run(batches):
        for b in batches:
            for _, joined, starts, _ in _parts(_normalised(b.column(0))):
                types, first, which = _types(joined, starts)
                n = np.bincount(which, minlength=len(types)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(_grams(joined, first)), pa.array(n)], names=["gram", "n"])

    ship_package(texts.sparkSession)
    return texts.select(F.col(text_col)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams that occur 1, 2, 3 and 4 times."""
    found = {r["n"]: r["types"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("types")).collect()}
    n1, n2, n3, n4 = (found.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]  # too little text to estimate them
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def fit(grams: DataFrame) -> DataFrame:
    """(gram, logp, bow): the model from its ``ORDER``-gram counts.

    ``logp`` is the log probability of the n-gram's last character after the
    others (null if it was never seen there), ``bow`` the log weight with which
    a text that goes on otherwise falls back to the shorter context (null if
    nothing follows it). Counts of lower orders are numbers of different left
    neighbours.
    """
    counts = {ORDER: cut_lineage(grams)}
    for k in range(ORDER - 1, 0, -1):
        longer = counts[k + 1]
        counts[k] = cut_lineage(longer.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    out, lower = None, None
    symbols = counts[1].count() + 1  # one for characters never seen
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        held = counts[k].withColumn("ctx", F.expr(f"left(gram, {k - 1})"))
        stats = held.groupBy("ctx").agg(F.sum("n").cast("double").alias("total"), F.sum(_discount(F.col("n"), d)).alias("over"))
        stats = stats.select("ctx", "total", (F.col("over") / F.col("total")).alias("rest"))
        known = held.join(stats, "ctx").withColumn("own", (F.col("n") - _discount(F.col("n"), d)) / F.col("total"))
        if lower is None:
            probs = known.select("gram", (F.col("own") + F.col("rest") / symbols).alias("p"))
            unseen = stats.select(F.lit("").alias("gram"), F.log(F.col("rest") / symbols).alias("logp"), F.lit(None).cast("double").alias("bow"))
            out = unseen
        else:
            shorter = lower.select(F.col("gram").alias("tail"), F.col("p").alias("below"))
            probs = known.withColumn("tail", F.expr(f"right(gram, {k - 1})")).join(shorter, "tail").select(
                "gram", (F.col("own") + F.col("rest") * F.col("below")).alias("p"))
            out = out.unionByName(stats.select(F.col("ctx").alias("gram"), F.lit(None).cast("double").alias("logp"),
                                               F.log("rest").alias("bow")))
        lower = cut_lineage(probs)
        out = out.unionByName(lower.select("gram", F.log("p").alias("logp"), F.lit(None).cast("double").alias("bow")))
    return cut_lineage(out.groupBy("gram").agg(F.max("logp").alias("logp"), F.max("bow").alias("bow")))


def _score(gram: str, logp: dict[str, float], bow: dict[str, float], unseen: float) -> float:
    """Log probability of an n-gram's last character: the longest n-gram the model knows, and the weights above it."""
    weight = 0.0
    for k in range(len(gram)):
        found = logp.get(gram[k:])
        if found is not None:
            return weight + found
        weight += bow.get(gram[k:-1], 0.0)
    return weight + unseen


def _pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One (block, rows) for each block of the rows, which are compressed; equal rows are one with their number."""
    at = table.schema.get_field_index("text")
    table = table.set_column(at, "text", _normalised(table.column("text")))
    table = table.group_by(table.column_names).aggregate([([], "count_all")])
    table = table.rename_columns([*table.column_names[:-1], "copies"]).sort_by("block")
    blocks = table.column("block").to_numpy()
    firsts = np.flatnonzero(np.diff(blocks, prepend=-1))
    kept = table.drop_columns("block").combine_chunks()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for first, after in zip(firsts, [*firsts[1:], len(blocks)]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept.schema, options=options) as out:
            out.write_table(kept.slice(first, after - first))
        yield pa.RecordBatch.from_arrays([pa.array([blocks[first]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                         names=["block", "rows"])


def _unpacked(table: pa.Table) -> Iterator[pa.Table]:
    for pack in table.column("rows"):
        yield pa.ipc.open_stream(pack.as_buffer()).read_all()


def log_likelihood(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, lang, n, logp): predicted characters of each row's text and the sum of their logs.

    Rows go to blocks by id and text, so that neither a hot id nor a hot text
    fills one block; rows equal in all three columns are scored once in a pack.
    """
    keep = [f for f in docs.schema if f.name in ("doc_id", "lang")]
    names = [f.name for f in keep]
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS) or 1
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), *names, "text")

    def dealt(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= PACK:
                yield from _pack(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from _pack(pa.Table.from_batches(held))

    def wanted(table):
        found, keys = set(), np.zeros(0, dtype=np.uint64)
        for pack in _unpacked(table):
            for _, joined, starts, _ in _parts(pack.column("text")):
                types, first, _ = _types(joined, starts)
                new = _unknown(types, keys)
                found.update(_grams(joined, first[new]))
                keys = np.sort(np.concatenate([keys, types[new]]))
        parts = {g[k:] for g in found for k in range(ORDER)} | {g[k:-1] for g in found for k in range(ORDER - 1)}
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * (len(parts) + 1), pa.int32()), "gram": pa.array([*parts, ""])})

    def scored(table, answers):
        def known(column):
            found = answers.select(["gram", column]).drop_null()
            return dict(zip(found.column("gram").to_pylist(), found.column(column).to_pylist()))

        logp, bow = known("logp"), known("bow")
        unseen = logp.get("", 0.0)
        keys, scores, out = np.zeros(0, dtype=np.uint64), np.zeros(0), []
        for pack in _unpacked(table):
            n, total = np.zeros(len(pack), dtype=np.int64), np.zeros(len(pack))
            for who, joined, starts, counts in _parts(pack.column("text")):
                types, first, which = _types(joined, starts)
                new = _unknown(types, keys)
                if new.any():
                    keys = np.concatenate([keys, types[new]])
                    scores = np.concatenate([scores, [_score(g, logp, bow, unseen) for g in _grams(joined, first[new])]])
                    order = np.argsort(keys)
                    keys, scores = keys[order], scores[order]
                each = scores[np.searchsorted(keys, types)][which]
                total[who] = np.add.reduceat(each, np.cumsum(counts) - counts)
                n[who] = counts
            out.append(pa.table({**{c: pack.column(c) for c in [*names, "copies"]}, "n": pa.array(n), "logp": pa.array(total)}))
        return pa.concat_tables(out)

    ship_package(docs.sparkSession)
    packs = rows.mapInArrow(dealt, "block int, rows binary")
    asked = packs.groupBy("block").applyInArrow(wanted, "block int, gram string")
    answers = asked.join(model, "gram").select("block", "gram", "logp", "bow")
    schema = T.StructType([*keep, T.StructField("copies", T.LongType()), T.StructField("n", T.LongType()),
                            T.StructField("logp", T.DoubleType())])
    out = packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)
    return out.select(*names, "n", "logp", F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy")).drop("copy")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of ``docs``: (doc_id, lang, trusted, perplexity, threshold, high_quality).

    ``labels`` has (doc_id, quality); documents with quality 1 are trusted. Null
    and blank texts have no perplexity and are not of high quality. Null
    languages are one language. Rows that repeat an id are scored one by one;
    a null id is not trusted. Without trusted text perplexities and thresholds
    are null and nothing is called low quality but blank texts.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    good = cut_lineage(good.where("good_id is not null"))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    rows = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0
    taught = rows.where(~unseen).join(good, F.col("doc_id") == good["good_id"], "left_semi")
    model = fit(gram_counts(taught))
    scored = log_likelihood(rows, model)
    marked = cut_lineage(scored.join(good, F.col("doc_id") == good["good_id"], "left")
                         .withColumn("trusted", F.col("good_id").isNotNull()).drop("good_id"))
    ppl = F.when((F.col("n") > 1) & F.lit(not model.isEmpty()), F.exp(-F.col("logp") / F.col("n")))
    marked = marked.withColumn("perplexity", ppl)
    held = marked.where(F.col("trusted") & unseen & F.col("perplexity").isNotNull())
    cut = F.expr(f"percentile_approx(perplexity, {quantile}, 10000)")
    by_lang = held.groupBy(F.col("lang").alias("l")).agg(cut.alias("own_cut"))
    anyway = held.agg(cut.alias("c")).first()["c"]
    limit = F.coalesce("own_cut", F.lit(anyway).cast("double"))
    joined = marked.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    return joined.select("doc_id", "lang", "trusted", "perplexity", limit.alias("threshold"),
                         ((F.col("n") > 1) & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("high_quality"))
