"""User and group directory: search and sorted listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import normalize_role


def users_search(users: DataFrame, q: str) -> DataFrame:
    """Lower-case substring on display name or e-mail."""
    w = q.lower()
    return users.filter(F.lower(F.coalesce("display_name", F.lit(""))).contains(w)
                        | F.lower(F.coalesce("email", F.lit(""))).contains(w))


def group_members(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with member counts (membership = department); a partial count
    per department is joined to the group table, never a member list."""
    counts = users.groupBy(F.col("department").alias("group_name")).agg(F.count(F.lit(1)).alias("member_count"))
    return groups.join(counts, "group_name", "left").fillna(0, ["member_count"])


def directory_search(users: DataFrame, groups: DataFrame, q: str) -> DataFrame:
    """Users whose name or e-mail contains q (q of 2+ chars, first 10 by
    name) and groups whose name contains q (1+ chars, first 20), with the
    group member count."""
    w = q.lower()
    out = None
    if len(q) >= 2:
        u = users_search(users, q).select(F.lit("user").alias("kind"), F.col("display_name").alias("name"),
                                          "email", F.lit(None).cast("long").alias("member_count"))
        out = u.orderBy("name", "email").limit(10)
    if len(q) >= 1:
        g = group_members(users, groups).filter(F.lower("group_name").contains(w)).select(
            F.lit("group").alias("kind"), F.col("group_name").alias("name"), F.lit(None).cast("string").alias("email"),
            "member_count").orderBy("name").limit(20)
        out = g if out is None else out.unionByName(g)
    return out


def users_sorted(users: DataFrame) -> DataFrame:
    """Users by display name with the normalized role."""
    return users.select("user_id", "email", "display_name", normalize_role("role").alias("role"), "department") \
        .orderBy("display_name", "user_id")


def groups_sorted(groups: DataFrame) -> DataFrame:
    """Groups by name with the normalized role."""
    return groups.select("group_name", normalize_role("role").alias("role")).orderBy("group_name")
