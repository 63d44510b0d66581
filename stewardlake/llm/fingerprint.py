"""Document fingerprints by a threshold-scaled sketch [DataFrame operations only].

A text's shingles are its runs of five words (fewer words: all of them); each
is hashed with XXH64. The sketch keeps every hash below a fixed share
(1 / ``SCALE``) of the hash range, so its size follows the text's. Which hashes
are kept does not depend on other texts: the sketch of two texts together is
``merge`` of their sketches, and the share of a sketch found in another
estimates the share of the text found there, however unequal the two are in
size.

The sketch of a short text can be empty. Such a text is ``bare``: it is compared
by all its hashes with all hashes of the other text, which is exact. Where two
texts meet (``edits``), the hashes are at hand or sent along for the bare ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut_lineage, running_totals, text_or_empty, words_of

SHINGLE = 5
SCALE = 8
#: Largest signed hash kept: the lowest 1 / SCALE of the signed 64-bit range.
LIMIT = -(1 << 63) + (1 << 64) // SCALE


def hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """XXH64 (signed) of every shingle of a text, repeats included (no words: none)."""
    w = words_of(text)

    def of(words):
        n = F.size(words)
        return F.transform(F.sequence(F.lit(1), F.greatest(n - (shingle - 1), F.lit(1))),
                           lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.least(n, F.lit(shingle))), " ")))

    return bound(w, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<bigint>")))


def kept(all_hashes: Column) -> Column:
    """The sketch of an array of hashes: sorted, without repeats."""
    return F.array_sort(F.array_distinct(F.filter(all_hashes, lambda x: x < F.lit(LIMIT))))


def sketch(text: Column) -> Column:
    return kept(hashes(text))


#: Characters in which a text of any length has some hash under the limit, almost always.
GLANCE = 4000


def bare(text: Column) -> Column:
    """Whether a text with words has no hash under the limit. The start of a long text mostly tells; else all of it does."""
    def low(h):
        return F.exists(h, lambda x: x < F.lit(LIMIT))

    # hashes of the start are hashes of the text, but for the last one, whose last word may be cut
    start = bound(hashes(F.substring(text, 1, GLANCE)), lambda h: F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))))
    return F.when((F.char_length(text) > GLANCE) & low(start), False).otherwise(bound(hashes(text), lambda h: (F.size(h) > 0) & ~low(h)))


def merge(a: Column, b: Column) -> Column:
    """Sketch of two texts together, from their sketches."""
    return kept(F.concat(a, b))


def pair(name: str) -> tuple[Column, Column]:
    """A sketch of ``edits`` and the text's hashes."""
    return F.col(name), F.col(f"{name}_all")


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(a)


def containment(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of ``a``'s shingles found in ``b`` (two texts without words: 1, one: 0), from (sketch, all hashes).

    Estimated from the sketches; exact if ``a``'s is empty. All hashes of both are needed only then."""
    (own, all_own), (other, all_other) = a, b
    return F.when(F.size(own) > 0, _share(own, other)).when(F.size(all_own) > 0, _share(all_own, all_other)).otherwise(
        F.when((F.size(other) == 0) & (F.size(all_other) == 0), 1.0).otherwise(0.0))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The larger containment of the two: 1 for equal texts or a text inside another, 0 without common shingles."""
    return F.greatest(containment(a, b), containment(b, a))


def resemblance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Estimated Jaccard likeness of the shingle sets; exact if both sketches are empty."""
    def of(x, y):
        return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))

    return F.when((F.size(a[0]) > 0) | (F.size(b[0]) > 0), of(a[0], b[0])).when(
        (F.size(a[1]) > 0) | (F.size(b[1]) > 0), of(a[1], b[1])).otherwise(1.0)


def as_text(s: Column) -> Column:
    """A sketch as one string: 16 hex digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document beside its edited text: (doc_id, next_id, text, edited, own, own_all, changed, changed_all,
    next_own, next_own_all).

    The edited text has the last quarter of its code points (rounded down)
    replaced by as many from the start of the next document, or all of it if
    it is shorter. Next is by ascending id, after the last comes the first;
    ``own``, ``changed`` and ``next_own`` are the sketches of the text, the
    edited text and the next text; the columns with ``_all`` have all different
    hashes where one of the two texts compared is bare, else nothing. Null texts count as empty; null ids come
    first; rows that repeat an id come by their texts' checksum, and those that
    repeat the text too share one place. A lone document follows itself. An
    empty table gives no rows; other columns are not looked at.

    Ranks come from a range sort of rows without texts. The texts are shuffled
    once, by key; each then sends its start and sketch to its predecessor's key.
    (Both readers of that shuffle need the same columns, so Spark reuses it.)
    """
    base = df.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    mark = F.xxhash64("text")
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), mark.cast("string"))
    slim = cut_lineage(base.select("doc_id", mark.alias("mark"), key.alias("key"), F.char_length("text").alias("n"), bare(F.col("text")).alias("bare"))
                       .distinct().withColumn("one", F.lit(1)))
    count, repeats = slim.count(), base.count()
    ranked = running_totals(slim, [], ["doc_id", "mark"], "one", "rank").select("key", "n", "bare", "rank")
    before = ranked.select(F.col("key").alias("prev_key"), F.floor(F.col("n") / 4).cast("int").alias("need"), F.col("bare").alias("prev_bare"),
                           (F.col("rank") % max(count, 1) + 1).alias("rank"))
    places = cut_lineage(ranked.join(before, "rank").select("key", "prev_key", "need", "bare", "prev_bare"))
    none = F.array().cast("array<bigint>")
    every = F.array_distinct(hashes(F.col("text")))
    texts = base.select("doc_id", "text", key.alias("key")).withColumn("own", sketch(F.col("text")))
    full = texts.repartition("key").join(places.hint("merge"), "key")
    heads = full.select(F.col("prev_key").alias("key"), F.col("doc_id").alias("next_id"),
                        F.expr("left(text, need)").alias("head"), F.col("own").alias("next_own"), F.col("bare").alias("next_bare"),
                        F.when(F.col("bare") | F.col("prev_bare"), every).otherwise(none).alias("next_own_all"))
    if repeats > count:
        heads = heads.dropDuplicates(["key"])
    both = full.join(heads.hint("merge"), "key")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 4) as int))"), "head")
    both = both.withColumn("edited", edited).withColumn("changed", sketch(F.col("edited")))
    exact = F.col("bare") | (F.size("changed") == 0)
    return both.select(
        "doc_id", "next_id", "text", "edited", "own", F.when(exact | F.col("next_bare"), every).otherwise(none).alias("own_all"),
        "changed", F.when(exact, F.array_distinct(hashes(F.col("edited")))).otherwise(none).alias("changed_all"), "next_own", "next_own_all")
