"""Refused rows as a result.

A rule table names what is wrong with a row: reason -> condition. ``judged``
gives every row the list of the reasons that hold; ``split`` writes the judged
rows once, partitioned by verdict, so that accepted and refused frames are two
folders of one pass, and counts them while they are written.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

NAME_MISSING = "name is required"
DESCRIPTION_MISSING = "description is required"
REF_MISSING = "productRef is required"
EMAIL_MISSING = "requesterEmail is required"
REASON_MISSING = "reason is required"
PRODUCT_UNKNOWN = "product not found"
TABLE_MISSING = "table name is required"
REGISTERED = "already registered"


def absent(c: str) -> Column:
    """Null, empty or blank."""
    return F.nullif(F.trim(F.col(c)), F.lit("")).isNull()


def judged(df: DataFrame, rules: dict[str, Column], name: str = "reasons") -> DataFrame:
    """Adds the reasons that hold, in the order of ``rules``; a null condition does not hold."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(broken, F.lit(why)) for why, broken in rules.items()])))


def accepted(rows: DataFrame, name: str = "reasons") -> DataFrame:
    return rows.filter(F.size(name) == 0).drop(name)


def refused(rows: DataFrame, name: str = "reasons") -> DataFrame:
    return rows.filter(F.size(name) > 0)


class Split(NamedTuple):
    accepted: DataFrame
    refused: DataFrame
    counts: dict[str, int]


def split(rows: DataFrame, rules: list[str], path: str, name: str = "reasons") -> Split:
    """Writes judged rows to ``path`` (a shared folder) in one pass; reads back the two verdicts.

    ``counts`` has submitted, accepted, refused and, per reason of ``rules``,
    the rows it holds for (a row may have several). An empty input gives two
    empty frames and zeros."""
    seen = Observation()
    ok = F.size(name) == 0
    watched = rows.observe(
        seen, F.count(F.lit(1)).alias("submitted"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("refused"),
        *[F.count_if(F.array_contains(name, why)).alias(why) for why in rules])
    watched.withColumn("verdict", F.when(ok, "accepted").otherwise("refused")).write.mode("overwrite").partitionBy("verdict").parquet(path)
    schema = rows.withColumn("verdict", F.lit("")).schema
    stored = rows.sparkSession.read.schema(schema).parquet(path)

    def of(verdict: str) -> DataFrame:
        return stored.filter(F.col("verdict") == verdict).drop("verdict")

    return Split(of("accepted").drop(name), of("refused"), seen.get)


# ---- rule tables -----------------------------------------------------------------------------
def judge_registrations(submissions: DataFrame) -> DataFrame:
    """M1: a product needs a name and a description."""
    return judged(submissions, {NAME_MISSING: absent("name"), DESCRIPTION_MISSING: absent("description")})


def judge_requests(submissions: DataFrame, products: DataFrame) -> DataFrame:
    """M5: a request needs a product, a requester and a reason, and the product must exist. Adds ``product_id``."""
    known = products.select("product_ref", "product_id").filter(F.col("product_ref").isNotNull())
    rows = submissions.drop("product_id").join(known, "product_ref", "left").select(
        *[c for c in submissions.columns if c != "product_id"], "product_id")
    return judged(rows, {
        REF_MISSING: absent("product_ref"), EMAIL_MISSING: absent("requester_email"), REASON_MISSING: absent("reason"),
        PRODUCT_UNKNOWN: ~absent("product_ref") & F.col("product_id").isNull()})


def judge_imports(selected: DataFrame, products: DataFrame) -> DataFrame:
    """A table needs a name and must not be registered yet (names compared without case, as in J5)."""
    key = F.lower(F.col("uc_full_name"))
    known = products.filter(F.nullif(F.trim("uc_full_name"), F.lit("")).isNotNull()).select(key.alias("_registered")).distinct()
    rows = selected.join(known, F.lower(F.col("full_name")) == F.col("_registered"), "left")
    return judged(rows, {TABLE_MISSING: absent("full_name"), REGISTERED: F.col("_registered").isNotNull()}).drop("_registered")
