"""Access over time: intervals of access and the calls inside and outside them (W1, W3 without one ``as_of``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bucket of the range join.
BUCKET_DAYS = 30
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
#: End of access that never expires.
OPEN_END = "TIMESTAMP_NTZ '9999-12-31 00:00:00'"


def access_intervals(requests: DataFrame) -> DataFrame:
    """(requester_id, product_id, from_at, to_at, n_grants): when each user had access to each product.

    A grant holds from its resolution to its expiry (a missing one: without
    end); Revoked ones held until they were revoked, which is not known here, so
    only Approved requests count. Grants that overlap or touch are one interval
    (gaps and islands). Grants that end before they begin hold never; a request
    without a resolution time holds from its request on.
    """
    granted = requests.where(F.col("status") == "Approved").select(
        "requester_id", "product_id", F.coalesce("resolved_at", "requested_at").alias("a"),
        F.coalesce("expires_at", F.expr(OPEN_END)).alias("b")).where(F.col("a") < F.col("b"))
    own = Window.partitionBy("requester_id", "product_id").orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    starts = granted.withColumn("first", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    islands = starts.withColumn("island", F.sum("first").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("requester_id", "product_id", "island").agg(
        F.min("a").alias("from_at"), F.max("b").alias("to_at"), F.count(F.lit(1)).alias("n_grants")).drop("island")


def _bucket(at: Column) -> Column:
    return F.floor(F.timestamp_diff("DAY", F.expr(EPOCH), at) / BUCKET_DAYS).cast("int")


def calls_with_access(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """``calls`` (user_id, product_id, called_at, ...) with ``from_at`` of the interval each falls in (null: none).

    A range join by time buckets: an interval stands in every bucket it touches
    between the first and the last call, a call in its own, and they meet on
    (user, product, bucket). A user or product with a third of all calls is so
    spread over the buckets, and what is left of a hot key is split by adaptive
    execution. An interval holds from its start, included, to its end, not
    included; intervals of a user and product never overlap, so a call meets one
    at most.
    """
    span = calls.select(F.struct(_bucket(F.min("called_at")).alias("a"), _bucket(F.max("called_at")).alias("b"))).scalar()
    held = intervals.withColumn("_s", span).where(F.col("_s.a").isNotNull())
    first, last = F.greatest(_bucket(F.col("from_at")), F.col("_s.a")), F.least(_bucket(F.col("to_at")), F.col("_s.b"))
    cut = held.where(first <= last).select(
        F.col("requester_id").alias("_u"), F.col("product_id").alias("_p"), "from_at", "to_at", F.explode(F.sequence(first, last)).alias("_b"))
    here = calls.withColumn("_bucket", _bucket(F.col("called_at")))
    inside = ((here["user_id"] == cut["_u"]) & (here["product_id"] == cut["_p"]) & (here["_bucket"] == cut["_b"])
              & (here["called_at"] >= cut["from_at"]) & (here["called_at"] < cut["to_at"]))
    return here.join(cut, inside, "left").select(*[here[c] for c in calls.columns], "from_at")


def calls_without_access(calls: DataFrame, intervals: DataFrame) -> DataFrame:
    """The calls that fall in no interval."""
    return calls_with_access(calls, intervals).where(F.col("from_at").isNull()).drop("from_at")
