"""Demand and spend: feature requests, votes, spend and finance reports
(J4, A4, P18, L4, M15, M16, A8, A16, A17, A18).

Votes are kept long (one row per request and voter). Per-request voter
lists are not collected into arrays: a single hot request may hold a third
of all votes, so "did this user vote" is a semi-join and the count is a
partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

# Fixture vocabulary: feature status derived from the source language.
STATUS_BY_LANG = [("en", "open"), ("de", "on_roadmap"), ("fr", "done"), ("es", "declined")]


def feature_requests_model(feature_requests: DataFrame) -> DataFrame:
    """Feature requests in the reference's shape: trimmed title, status and
    requester (fixture: status from the language, requester from the source)."""
    st = None
    for lang, status in STATUS_BY_LANG:
        st = F.when(F.col("status_src") == lang, status) if st is None else st.when(F.col("status_src") == lang, status)
    return feature_requests.select(
        "request_id", F.trim("title").alias("title"), st.otherwise("open").alias("status"),
        F.col("requester").alias("requester_email"))


def voters_by_request(votes: DataFrame, users: DataFrame) -> DataFrame:
    """A4: voter e-mails per request (long form) with the request's voter count."""
    v = votes.select("request_id", "voter_id").distinct().join(
        users.select(F.col("user_id").alias("voter_id"), F.col("email").alias("voter_email")), "voter_id", "inner")
    counts = v.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_voters"))
    return v.join(counts, "request_id", "inner").select("request_id", "voter_email", "n_voters")


def votes_left_join(requests: DataFrame, votes: DataFrame, viewer_email: str, viewer_id: int) -> DataFrame:
    """Every feature request with its vote count and whether the viewer
    requested it or voted for it (LEFT JOIN of the per-request aggregate)."""
    agg = votes.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("upvotes"),
        F.bool_or(F.col("voter_id") == viewer_id).alias("viewer_voted"))
    j = requests.join(agg, "request_id", "left")
    return j.select(
        "request_id", "title", "status", "requester_email",
        F.coalesce("upvotes", F.lit(0)).alias("upvotes"),
        ((F.col("requester_email") == viewer_email) | F.coalesce("viewer_voted", F.lit(False))).alias("user_voted"))


def feature_tabs(with_votes: DataFrame, search: str = "") -> DataFrame:
    """(tab, request) rows for All (hides declined), On Roadmap, My
    Requests (own or voted) and Done, after a case-insensitive title search."""
    df = with_votes
    if search:
        df = df.filter(F.lower("title").contains(search.lower()))
    tabs = F.array_compact(F.array(
        F.when(F.col("status") != "declined", F.lit("All")),
        F.when(F.col("status") == "on_roadmap", F.lit("On Roadmap")),
        F.when(F.col("user_voted"), F.lit("My Requests")),
        F.when(F.col("status") == "done", F.lit("Done")),
    ))
    return df.select(F.explode(tabs).alias("tab"), "request_id", "title", "status")


def feature_ranking(with_votes: DataFrame) -> DataFrame:
    """L4: upvotes desc, then newest (request id as creation order) first."""
    return with_votes.orderBy(F.desc("upvotes"), F.desc("request_id"))


def spend_by_resource(usage: DataFrame, app_tag: str) -> DataFrame:
    """DBUs by day, usage type and a resource label derived from the app
    tag and ordered SKU patterns. As in the reference, one pattern of the
    label rules is not part of the row filter."""
    sku, tag = F.col("sku_name"), F.col("tag_app")
    resource = F.when(tag == app_tag, rules.SPEND_TAG_LABEL)
    for label, patterns in rules.SPEND_RESOURCE_RULES:
        hit = None
        for p in patterns:
            hit = sku.like(p) if hit is None else hit | sku.like(p)
        resource = resource.when(hit, label)
    resource = resource.otherwise(rules.SPEND_OTHER_LABEL)
    keep = tag == app_tag
    for p in rules.SPEND_FILTER_PATTERNS:
        keep = keep | sku.like(p)
    return (
        usage.filter(F.coalesce(keep, F.lit(False)))
        .groupBy("usage_date", "usage_type", resource.alias("resource"))
        .agg(F.round(F.sum("usage_quantity"), 4).alias("dbus"))
    )


def budget_variance(lineitem: DataFrame, orders: DataFrame, customers: DataFrame, k: int = 5) -> DataFrame:
    """A16 (doc-only; our semantics): per department (customer segment), the
    budget is the ordered total and the actual the net line amount; variance
    = budget - actual; the k departments with the largest budget.
    Line amounts are pre-aggregated per order before the join, so the join
    carries one row per order, not per line."""
    net = lineitem.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual"))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice")
    c = customers.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("department"))
    j = o.join(net, o.o_orderkey == net.l_orderkey, "left").join(c, "o_custkey", "inner")
    agg = j.groupBy("department").agg(
        F.sum("o_totalprice").alias("budgeted"), F.sum(F.coalesce("actual", F.lit(0.0))).alias("actual"))
    return agg.select(
        "department", F.round("budgeted", 2).alias("budgeted"), F.round("actual", 2).alias("actual"),
        F.round(F.col("budgeted") - F.col("actual"), 2).alias("variance"),
    ).orderBy(F.desc("budgeted"), "department").limit(k)


def vendor_flags(lineitem: DataFrame, suppliers: DataFrame) -> DataFrame:
    """A17 (doc-only; our semantics): per supplier payments (net line amount)
    and line count; 'review' when the total is over mean + 2 standard
    deviations of all suppliers, 'low_activity' under 10 lines, else 'ok'."""
    per = lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"),
        F.count(F.lit(1)).alias("n_lines"))
    per = suppliers.select("s_suppkey", "s_name").join(per, "s_suppkey", "left").fillna(0, ["paid", "n_lines"])
    stats = per.select(F.struct(F.avg("paid").alias("mean"), F.stddev_samp("paid").alias("sd"))).scalar()
    per = per.withColumn("_s", stats)
    flag = (
        F.when(F.col("paid") > F.col("_s.mean") + 2 * F.coalesce(F.col("_s.sd"), F.lit(0.0)), "review")
        .when(F.col("n_lines") < 10, "low_activity").otherwise("ok"))
    return per.select("s_suppkey", "s_name", F.round("paid", 2).alias("paid"), "n_lines", flag.alias("flag"))


def billing_outliers(usage: DataFrame, z: float = 2.0) -> DataFrame:
    """A18 (doc-only; our semantics): daily charges per usage type; a day is an
    outlier when its z-score within the type exceeds ``z``. The window runs
    over daily aggregates (days x types rows), never over raw usage."""
    daily = usage.groupBy("usage_type", "usage_date").agg(F.sum("usage_quantity").alias("qty"))
    w = Window.partitionBy("usage_type")
    scored = daily.withColumn("mean", F.avg("qty").over(w)).withColumn("sd", F.stddev_samp("qty").over(w))
    zc = (F.col("qty") - F.col("mean")) / F.col("sd")
    return scored.filter(F.abs(zc) > z).select(
        "usage_type", "usage_date", F.round("qty", 4).alias("qty"), F.round(zc, 4).alias("z_score"))


def toggle_votes(votes: DataFrame, toggles: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """A batch of vote toggles (request_id, voter_id, seq). An odd number
    of toggles flips the pair's state; even leaves it. Returns the new votes
    and the recounted upvotes (never below 0)."""
    par = toggles.groupBy("request_id", "voter_id").agg((F.count(F.lit(1)) % 2 == 1).alias("flip")) \
        .filter("flip").drop("flip")
    cur = votes.select("request_id", "voter_id").distinct()
    removed = cur.join(par, ["request_id", "voter_id"], "left_anti")
    added = par.join(cur, ["request_id", "voter_id"], "left_anti")
    new_votes = removed.unionByName(added)
    counts = new_votes.groupBy("request_id").agg(F.count(F.lit(1)).alias("upvotes"))
    upv = requests.select("request_id").join(counts, "request_id", "left").select(
        "request_id", F.greatest(F.coalesce("upvotes", F.lit(0)), F.lit(0)).alias("upvotes"))
    return {"feature_request_votes": new_votes, "upvotes": upv}


def submit_features(requests: DataFrame, submissions: DataFrame) -> dict[str, DataFrame]:
    """M16 submit: trimmed, non-empty titles become open requests with an
    automatic vote by the submitter; ids continue after the current max."""
    from .common import sequence_numbers

    ok = submissions.withColumn("title", F.trim("title")).filter(F.col("title").isNotNull() & (F.col("title") != ""))
    base = requests.select(F.coalesce(F.max("request_id"), F.lit(0)).alias("m")).scalar()
    num = sequence_numbers(ok, ["submission_id"], "_seq").withColumn("request_id", base + F.col("_seq"))
    new = num.select("request_id", "title", F.lit("open").alias("status"), "requester_email")
    votes = num.select("request_id", F.col("submitter_id").alias("voter_id"))
    return {"feature_requests": requests.unionByName(new), "new_votes": votes}


def set_feature_status(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """M16 status: of a request's (request_id, status, changed_seq) rows with an
    allowed status the latest sets its status."""
    seq = F.col("changed_seq") if "changed_seq" in changes.columns else F.lit(0)
    ok = changes.filter(F.col("status").isin(*rules.FEATURE_STATUSES)).groupBy("request_id").agg(
        F.max(F.struct(seq.alias("s"), "status"))["status"].alias("_new"))
    return requests.join(ok, "request_id", "left").withColumn(
        "status", F.coalesce("_new", F.col("status"))).drop("_new")


#: A value is an outlier this many times the scaled median deviation away from the median.
ROBUST_Z = 3.5
#: Median deviations to a standard deviation of normal values.
MAD_SCALE = 1.4826
#: Size of the quantile sketches: ranks are right to about 1.4 percent.
SKETCH_K = 200


def _median(values: Column, sketch: bool) -> Column:
    if sketch:
        return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(values, SKETCH_K), F.lit(0.5))
    return F.median(values)


def robust_scores(values: DataFrame, groups: list[str], value: str, sketch: bool = False) -> DataFrame:
    """Adds ``median``, ``mad`` and ``robust_z`` of each value within its group.

    Median and median deviation do not move with the outlier itself, so one
    extreme among few values is seen, where it stretches mean and deviation. The
    exact medians keep every different value of a group in one buffer; with
    ``sketch`` they come from mergeable KLL sketches of fixed size, one pass for
    the median and one for the deviation, whose ranks are off by 1.4 percent at
    most in nearly all cases. With a deviation of 0 any other value is
    infinitely far. Null values have no score.
    """
    given = values.where(F.col(value).isNotNull())
    if groups:
        key, same = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.lit(True)
        for i, g in enumerate(groups):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        mid = given.groupBy(*key).agg(_median(F.col(value).cast("double"), sketch).alias("median"))
        apart = given.join(mid, same).withColumn("_d", F.abs(F.col(value) - F.col("median")))
        mad = apart.groupBy(*[f"_g{i}" for i in range(len(groups))]).agg(F.first("median").alias("median"), _median(F.col("_d"), sketch).alias("mad"))
        scored = values.join(mad, same, "left")
    else:  # one number each for all values
        mid = given.select(_median(F.col(value).cast("double"), sketch)).scalar()
        mad = given.withColumn("_m", mid).select(_median(F.abs(F.col(value) - F.col("_m")), sketch)).scalar()
        scored = values.withColumns({"median": mid, "mad": mad})
    z = F.when(F.col(value) == F.col("median"), F.lit(0.0)).otherwise(
        F.try_divide(F.col(value) - F.col("median"), MAD_SCALE * F.col("mad")))
    far = F.when(F.col(value) > F.col("median"), float("inf")).otherwise(float("-inf"))
    far = F.when(F.col(value).isNotNull() & F.col("median").isNotNull(), F.coalesce(z, far))
    return scored.withColumn("robust_z", far).drop(*[f"_g{i}" for i in range(len(groups))])


def billing_outliers_robust(usage: DataFrame, z: float = ROBUST_Z, sketch: bool = False) -> DataFrame:
    """A18 with median and median deviation: daily charges per usage type that are far from the type's usual day."""
    daily = usage.groupBy("usage_type", "usage_date").agg(F.sum("usage_quantity").alias("qty"))
    scored = robust_scores(daily, ["usage_type"], "qty", sketch)
    return scored.where(F.abs("robust_z") > z).select(
        "usage_type", "usage_date", F.round("qty", 4).alias("qty"), F.round("median", 4).alias("median"), F.round("robust_z", 4).alias("robust_z"))


def vendor_flags_robust(lineitem: DataFrame, suppliers: DataFrame, z: float = ROBUST_Z, sketch: bool = False) -> DataFrame:
    """A17 with median and median deviation: 'review' when a vendor's total is far over the usual one."""
    per = vendor_flags(lineitem, suppliers).drop("flag")
    scored = robust_scores(per, [], "paid", sketch)
    flag = F.when(F.col("robust_z") > z, "review").when(F.col("n_lines") < 10, "low_activity").otherwise("ok")
    return scored.select("s_suppkey", "s_name", "paid", "n_lines", F.round("robust_z", 4).alias("robust_z"), flag.alias("flag"))
