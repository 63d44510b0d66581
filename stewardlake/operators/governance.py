"""Governance: masking, gated preview, group roles, request policy, audit
(G1, G2, J10, J13, L3, M9, F5, F6, F10, F11, F13, F19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.classify import classify_sensitivity, elevated_pii, normalize_role
from ..functions.grants import audit_metadata
from ..functions.sampling import stable_unit
from ..sources.fixtures import days
from .common import sequence_numbers

MASK_TEXT = "****"


def column_classes(df: DataFrame, tags: DataFrame | None = None) -> dict[str, tuple[str, bool]]:
    """Sensitivity and elevated flag for each column of ``df``'s schema;
    ``tags`` are the column tags of this table.

    The result is schema metadata (one entry per column of one table), so its
    size is bounded by the column count; it is needed on the driver because
    the masking projection must be fixed before the query is built.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    if tags is not None:
        # Repeated tag names of a column: the largest value, as in J9.
        one = tags.groupBy("column_name", "tag_name").agg(F.max("tag_value").alias("tag_value"))
        tagmap = one.groupBy("column_name").agg(
            F.map_from_entries(F.collect_list(F.struct("tag_name", "tag_value"))).alias("tags"))
        names = names.join(tagmap, "column_name", "left")
        sens = classify_sensitivity("column_name", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    else:
        sens = classify_sensitivity("column_name")
    rows = names.select("column_name", sens.alias("s")).select(
        "column_name", "s", elevated_pii("s", "column_name").alias("e")).collect()
    return {r["column_name"]: (r["s"], bool(r["e"])) for r in rows}


def _mask(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, T.StringType):
        return F.when(F.col(name).isNotNull(), F.lit(MASK_TEXT)).alias(name)
    return F.lit(None).cast(dt).alias(name)


def mask_table(df: DataFrame, classes: dict[str, tuple[str, bool]], access: str, strict: bool = False) -> DataFrame:
    """G1: masked (PII / CONFIDENTIAL) columns are hidden without access;
    with standard access only elevated PII stays hidden; ``strict`` also
    hides columns that have no classification (new columns)."""
    cols = []
    for c in df.columns:
        sens, elevated = classes.get(c, (None, False))
        if sens is None:
            hide = strict
        elif access == "none":
            hide = sens in ("PII", "CONFIDENTIAL")
        elif access == "standard":
            hide = elevated
        else:  # elevated / admin
            hide = False
        cols.append(_mask(df, c) if hide else F.col(c))
    return df.select(*cols)


def gated_preview(state: DataFrame, product_id: int | Column, product_rows: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The first n rows of a product's data, returned only to users who
    may query it (the same n rows for each such user). The preview is folded
    into one array of at most n rows by a scalar subquery and exploded per
    viewer, so there is no join and nothing grows beyond n per viewer. Columns
    are masked by the viewer's access level (G1)."""
    pid = product_id if isinstance(product_id, Column) else F.lit(product_id)
    viewers = state.filter((F.col("product_id") == pid) & F.col("can_query")).select(
        F.col("requester_id").alias("viewer_id"), viewer_access(F.col("state")).alias("_access"))
    preview = product_rows.orderBy(*key).limit(n)
    rows = preview.select(F.collect_list(F.struct(*preview.columns)).alias("rows")).scalar()
    shown = viewers.select("viewer_id", "_access", F.inline(rows))
    return masked_for(shown, column_classes(product_rows), "_access").drop("_access")


def viewer_access(state: Column) -> Column:
    """Access level that a viewer's state gives: admins see everything, granted viewers have standard access."""
    return F.when(state == "admin", "admin").when(state == "granted", "standard").otherwise("none")


def masked_for(df: DataFrame, classes: dict[str, tuple[str, bool]], access: str) -> DataFrame:
    """G1 with the viewer's access level in a column: elevated PII stays hidden
    under standard access, PII and confidential columns without any."""
    cols = []
    for c in df.columns:
        sens, elevated = classes.get(c, (None, False))
        hidden = [lvl for lvl, hide in (("none", sens in ("PII", "CONFIDENTIAL")), ("standard", elevated)) if hide]
        cols.append(F.when(F.col(access).isin(hidden), _mask(df, c)).otherwise(F.col(c)).alias(c) if hidden else F.col(c))
    return df.select(*cols)


def gated_previews(state: DataFrame, rows: DataFrame, product_col: str, key: list[str], n: int = 5,
                   classes: dict[str, tuple[str, bool]] | None = None) -> DataFrame:
    """G2 for every product at once: the first n rows of each product's data
    (a per-product top-n, planned as a WindowGroupLimit so a product with a
    third of all rows ships at most n per task) joined to the (viewer,
    product) pairs that may query it: at most n rows per pair. Columns are
    masked by each viewer's access level (G1); ``classes`` defaults to the
    classes that the column names give."""
    classes = column_classes(rows) if classes is None else classes
    w = Window.partitionBy(product_col).orderBy(*key)
    preview = (rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
               .withColumn("rank", F.col("rank").cast("long")))
    viewers = state.filter(F.col("can_query")).select(F.col("requester_id").alias("viewer_id"),
                                                      F.col("product_id").alias(product_col),
                                                      viewer_access(F.col("state")).alias("_access"))
    return masked_for(viewers.join(preview, product_col, "inner"), classes, "_access").drop("_access")


def user_group_role(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Per user, the best role among its groups (admin > steward > rest).
    Group membership is the department here; several groups per user are
    exploded first. Best role is a min over a priority struct (partial agg)."""
    member = users.select("user_id", F.explode(F.array("department")).alias("group_name"))
    j = member.join(groups.select("group_name", "role"), "group_name", "inner")
    prio = F.when(F.lower("role") == "admin", 0).when(F.lower("role") == "steward", 1).otherwise(2)
    best = j.groupBy("user_id").agg(F.min(F.struct(prio.alias("p"), F.col("group_name"), F.col("role"))).alias("b"))
    return best.select("user_id", F.col("b.group_name").alias("group_name"), F.col("b.role").alias("group_role"))


def policy_level(method: Column, path: Column) -> tuple[Column, Column]:
    """J13 rule table as one expression: (level, rule index); first match wins;
    unmatched -> admin with index NULL. No join with the rule table at all."""
    idx = policy_rule(method, path)
    return policy_level_of(idx), idx


def policy_rule(method: Column, path: Column) -> Column:
    """Index of the first rule that matches a call (none: NULL)."""
    idx = None
    for i, (m, pattern, _) in enumerate(rules.POLICY_RULES):
        cond = path.rlike(pattern) if m == "*" else (method == m) & path.rlike(pattern)
        idx = F.when(cond, i) if idx is None else idx.when(cond, i)
    return idx.otherwise(F.lit(None).cast("int"))


def policy_level_of(rule_index: Column) -> Column:
    """Level of a rule by its index (no rule: the default level)."""
    levels = F.array(*[F.lit(lvl) for _, _, lvl in rules.POLICY_RULES])
    return F.coalesce(F.get(levels, rule_index), F.lit(rules.POLICY_DEFAULT_LEVEL))


def policy_audit(access_log: DataFrame) -> DataFrame:
    """The access level each logged call required, and the rule that decided."""
    ruled = access_log.select("log_id", "method", "path", "user_id", policy_rule(F.col("method"), F.col("path")).alias("rule_index"))
    # Two projections: the regexes run once per call, the level is looked up by their result.
    return ruled.select("log_id", "method", "path", "user_id", policy_level_of(F.col("rule_index")).alias("level"), "rule_index")


def audit_recent(audit: DataFrame, n: int = 50) -> DataFrame:
    """L3: the latest n audit rows (ties by log id)."""
    return audit.orderBy(F.desc("occurred_at"), F.desc("log_id")).limit(n)


def nudge_events(requests: DataFrame, users: DataFrame, as_of: Column, older_than_days: int = 30) -> DataFrame:
    """M9 rows: a NUDGE_SENT event for every request still Pending after
    ``older_than_days`` (no log id yet; ``audit_append`` assigns it)."""
    pend = requests.filter((F.col("status") == "Pending") & (F.col("requested_at") < as_of - days(older_than_days)))
    u = users.select(F.col("user_id").alias("requester_id"))
    return pend.join(u, "requester_id", "left_semi").select(
        F.lit("NUDGE_SENT").alias("event_type"),
        F.col("requester_id").alias("actor_id"),
        audit_metadata(request_id=F.col("request_id"),
                       message=F.lit("Requester sent a reminder to approver")).alias("metadata"),
        as_of.alias("occurred_at"),
    )


def audit_append(audit: DataFrame, new_events: DataFrame) -> DataFrame:
    """M9: append event rows. An event is the same as another only if type,
    actor, metadata and time agree; such repeats, in the batch or already
    present, are skipped, so rerunning a batch appends nothing. New log ids
    continue after the current maximum in (occurred_at, metadata, event_type,
    actor_id) order, which no two of them share."""
    key = ["event_type", "actor_id", "metadata", "occurred_at"]
    fresh = new_events.dropDuplicates(key).join(audit.select(*key), key, "left_anti")
    base = audit.select(F.coalesce(F.max("log_id"), F.lit(0)).alias("m")).scalar()
    numbered = sequence_numbers(fresh.withColumn("_k", F.concat_ws("|", F.col("occurred_at").cast("string"), "metadata")),
                                ["_k", "event_type", "actor_id"], "_seq")
    rows = numbered.select((base + F.col("_seq")).alias("log_id"), *[c for c in audit.columns if c != "log_id"])
    return audit.unionByName(rows)


def backfill_last_refreshed(products: DataFrame, as_of: Column) -> DataFrame:
    """NULL last_refreshed becomes as_of minus a pseudo-random part of the
    frequency period; the fraction is a fixed function of the product id, so
    reruns and recomputed partitions agree."""
    span = None
    for name, d in rules.BACKFILL_SPAN_DAYS:
        span = F.when(F.col("refresh_frequency") == name, F.lit(d)) if span is None else span.when(
            F.col("refresh_frequency") == name, F.lit(d))
    span = span.otherwise(F.lit(rules.BACKFILL_DEFAULT_SPAN_DAYS))
    frac = stable_unit(F.col("product_id"), 0, 0)
    secs = F.floor(frac * span * 86400).cast("long")
    filled = as_of - F.make_dt_interval(secs=secs.cast("decimal(18,6)"))
    need = F.col("last_refreshed").isNull() & F.col("refresh_frequency").isNotNull()
    return products.withColumn("last_refreshed", F.when(need, filled).otherwise(F.col("last_refreshed")))


def users_with_roles(users: DataFrame) -> DataFrame:
    """F6 over a user table: normalized role."""
    return users.select("user_id", "email", "role", normalize_role("role").alias("normalized_role"))
