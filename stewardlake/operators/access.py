"""Access requests: listings, per-(user, product) access state, library,
notifications and request counters (J1-J3, P16, P17, W1-W3, U1, U2, U4,
A2, A3, A7, L2, G3, J14).

Scale notes
-----------
* "Pick the best request per (user, product)" is a ``max`` over an ordered
  struct (a hash aggregate with map-side partial aggregation), not a
  ``row_number`` window: a user or product holding a third of all requests
  is folded to one row per map task before the shuffle.
* Per-user top-k (notifications, recently accessed) uses ``row_number`` with
  a ``<= k`` filter, which Spark plans as a WindowGroupLimit (partial limit
  before the shuffle), so a hot user never ships more than k rows per task.
* Dimension joins (products, users) are equi-joins on surrogate keys; the
  planner broadcasts them only when its size estimate is under the
  configured threshold, otherwise it sort-merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import normalize_role
from ..sources.fixtures import days


def _products_dim(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", "product_ref", F.col("display_name").alias("product_name"), "domain",
        F.col("type").alias("product_type"), "uc_full_name",
    )


def _users_dim(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("user_id").alias("requester_id"), F.col("email").alias("requester_email"),
        F.col("display_name").alias("requester_name"), F.col("department").alias("requester_team"),
    )


def requests_detail(requests: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Requests JOIN products JOIN users (newest first is a presentation
    order; callers sort or page as needed)."""
    return (
        requests.join(_users_dim(users), "requester_id", "inner")
        .join(_products_dim(products), "product_id", "inner")
        .select(
            "request_id", "status", "business_reason", "requested_at", "resolved_at", "expires_at",
            "product_id", "product_ref", "product_name", "domain", "product_type",
            "requester_id", "requester_email", "requester_name", "requester_team",
        )
    )


def requests_filter(detail: DataFrame, email: str | None = None, status: str | None = None) -> DataFrame:
    """Optional requester e-mail and status predicates."""
    df = detail
    if email:
        df = df.filter(F.col("requester_email") == email)
    if status:
        df = df.filter(F.col("status") == status)
    return df


def requests_pending(requests: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Pending requests with product table name (filter below the joins)."""
    pend = requests.filter(F.col("status") == "Pending")
    return (
        pend.join(_products_dim(products), "product_id", "inner")
        .join(_users_dim(users), "requester_id", "inner")
        .select("request_id", "status", "business_reason", "requested_at", "product_ref", "product_name",
                "domain", "uc_full_name", "requester_email", "requester_name", "requester_team")
    )


def granted_access(requests: DataFrame, products: DataFrame, users: DataFrame,
                   product_ref: str | None = None) -> DataFrame:
    """Approved grants per product (one product when ``product_ref``)."""
    prods = products.select("product_id", "product_ref")
    if product_ref:
        prods = prods.filter(F.col("product_ref") == product_ref)
    appr = requests.filter(F.col("status") == "Approved")
    return (
        appr.join(prods, "product_id", "inner").join(_users_dim(users), "requester_id", "inner")
        .select("product_ref", "request_id", "requested_at", "resolved_at", "expires_at",
                "requester_email", "requester_name")
    )


UUID_LIKE = r"^[0-9a-fA-F-]{36}$"


def requests_by_id_or_ref(requests: DataFrame, lookups: DataFrame) -> DataFrame:
    """Each lookup ``id`` that is 36 hex/dash chars matches request_id,
    any other matches request_ref. One equi-join on (kind, key): each request
    offers its two keys, each lookup asks for one kind, so the requests are
    scanned once and no OR-condition join is needed."""
    cols = ["request_id", "request_ref", "status", "product_id", "requester_id"]
    keyed = requests.select(*cols, F.inline(F.array(
        F.struct(F.lit("id").alias("kind"), F.col("request_id").alias("key")),
        F.struct(F.lit("ref").alias("kind"), F.col("request_ref").alias("key")))))
    asked = lookups.select("id", F.when(F.col("id").rlike(UUID_LIKE), "id").otherwise("ref").alias("kind"),
                           F.col("id").alias("key"))
    return asked.join(keyed, ["kind", "key"], "inner").select("id", *cols)


def _not_expired(as_of: Column) -> Column:
    return F.col("expires_at").isNull() | (F.col("expires_at") >= as_of)


def access_state(requests: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Per (user, product) with at least one request:
    granted (Approved, not expired) > revoked > pending > admin > none; within a
    class the newest COALESCE(resolved_at, requested_at) wins, ties by the
    larger request_id. Admins are users whose normalized role is admin."""
    cls = (
        F.when((F.col("status") == "Approved") & _not_expired(as_of), 0)
        .when(F.col("status") == "Revoked", 1)
        .when(F.col("status") == "Pending", 2)
        .otherwise(9)
    )
    ranked = requests.select(
        "requester_id", "product_id",
        F.struct(
            (-cls).alias("neg_class"),
            F.coalesce("resolved_at", "requested_at").alias("ts"),
            F.col("request_id").alias("request_id"),
        ).alias("k"),
    )
    best = ranked.groupBy("requester_id", "product_id").agg(F.max("k").alias("best"))
    admins = users.filter(normalize_role("role") == "admin").select(
        F.col("user_id").alias("requester_id"), F.lit(True).alias("is_admin"))
    cls_best = -F.col("best.neg_class")
    state = (
        F.when(cls_best == 0, "granted").when(cls_best == 1, "revoked").when(cls_best == 2, "pending")
        .when(F.col("is_admin"), "admin").otherwise("none")
    )
    return (
        best.join(admins, "requester_id", "left")
        .select(
            "requester_id", "product_id", state.alias("state"),
            F.when(cls_best <= 2, F.col("best.request_id")).alias("request_id"),
        )
        .withColumn("can_query", F.col("state").isin("granted", "admin"))
    )


def can_query(state: DataFrame) -> DataFrame:
    """Pairs whose state allows querying."""
    return state.filter(F.col("can_query")).select("requester_id", "product_id", "state")


def approved_access(requests: DataFrame, as_of: Column) -> DataFrame:
    """(user, product) with an Approved, unexpired request."""
    return (
        requests.filter((F.col("status") == "Approved") & _not_expired(as_of))
        .select("requester_id", "product_id").distinct()
    )


def user_library(requests: DataFrame, library: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Approved requests UNION ALL pinned items, for all users at once."""
    prod = products.select(
        "product_id", "product_ref", F.col("display_name").alias("product_name"), "domain",
        F.col("type").alias("product_type"), "refresh_frequency", "source_system", "uc_full_name")
    known = users.select(F.col("user_id"))
    approved = (
        requests.filter(F.col("status") == "Approved")
        .select(F.col("requester_id").alias("user_id"), "product_id",
                F.lit("approved").alias("source"), F.col("resolved_at").alias("added_at"), "request_id")
    )
    pinned = library.select(
        "user_id", "product_id", F.lit("library").alias("source"),
        (F.col("added_at") if "added_at" in library.columns else F.lit(None).cast("timestamp_ntz")).alias("added_at"),
        F.lit(None).cast("string").alias("request_id"),
    )
    return approved.unionByName(pinned).join(prod, "product_id", "inner").join(known, "user_id", "left_semi")


def notifications(requests: DataFrame, products: DataFrame, as_of: Column, only_future: bool = False) -> DataFrame:
    """Per user, the 5 soonest-expiring approvals (expires_at < as_of +
    14 days; no lower bound, as the reference, unless ``only_future`` keeps
    only approvals not yet expired) and the 10 newest resolutions within the
    last 7 days."""
    prod = products.select("product_id", "product_ref", F.col("display_name").alias("product_name"))
    expiring = requests.filter(
        (F.col("status") == "Approved") & (F.col("expires_at") < as_of + days(rules.EXPIRING_WITHIN_DAYS)))
    if only_future:
        expiring = expiring.filter(F.col("expires_at") >= as_of)
    w_exp = Window.partitionBy("requester_id").orderBy(F.asc("expires_at"), F.asc("request_id"))
    expiring = (
        expiring.withColumn("rank", F.row_number().over(w_exp)).filter(F.col("rank") <= rules.EXPIRING_LIMIT)
        .withColumn("rank", F.col("rank").cast("long"))
        .withColumn("kind", F.lit("Expiring"))
    )
    recent = requests.filter(
        F.col("status").isin(*rules.RECENT_STATUSES) & (F.col("resolved_at") > as_of - days(rules.RECENT_WITHIN_DAYS)))
    w_rec = Window.partitionBy("requester_id").orderBy(F.desc("resolved_at"), F.asc("request_id"))
    recent = (
        recent.withColumn("rank", F.row_number().over(w_rec)).filter(F.col("rank") <= rules.RECENT_LIMIT)
        .withColumn("rank", F.col("rank").cast("long"))
        .withColumn("kind", F.col("status"))
    )
    cols = ["requester_id", "kind", "rank", "request_id", "resolved_at", "expires_at", "product_id"]
    return (
        expiring.select(*cols).unionByName(recent.select(*cols))
        .join(prod, "product_id", "inner")
        .select("requester_id", "kind", "rank", "request_id", "resolved_at", "expires_at", "product_ref", "product_name")
    )


def recently_accessed(requests: DataFrame, products: DataFrame, k: int = 4) -> DataFrame:
    """L2: per user the k latest approved requests (by resolved_at)."""
    w = Window.partitionBy("requester_id").orderBy(F.desc("resolved_at"), F.asc("request_id"))
    top = (
        requests.filter(F.col("status") == "Approved")
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
    )
    prod = products.select("product_id", "product_ref", F.col("display_name").alias("product_name"),
                           F.coalesce("type", F.lit("Dataset")).alias("product_type"))
    return top.join(prod, "product_id", "inner").select(
        "requester_id", "rank", "request_id", "resolved_at", "product_ref", "product_name", "product_type")


def request_status_counts(requests: DataFrame) -> DataFrame:
    """A2: counts of Pending / Approved / Denied in one row."""
    st = F.col("status")
    return requests.agg(
        F.count_if(st == "Pending").alias("pending"),
        F.count_if(st == "Approved").alias("approved"),
        F.count_if(st == "Denied").alias("denied"),
    )


def my_status_counts(requests: DataFrame) -> DataFrame:
    """A3: the same per requester."""
    st = F.col("status")
    return requests.groupBy("requester_id").agg(
        F.count_if(st == "Pending").alias("pending"),
        F.count_if(st == "Approved").alias("approved"),
        F.count_if(st == "Denied").alias("denied"),
    )


def insight_stats(state: DataFrame, published: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: published products accessible / available to request, and
    the catalog-wide counts of dashboard-like types and of everything else.

    Computed from counts, never by pairing every user with every product:
    a non-admin can query exactly its granted products; an admin can query
    every product except those where a revoked or pending request outranks
    the admin state.
    """
    pub = published.select("product_id")
    # Both catalog-wide counts come from one scalar subquery, attached once.
    totals = published.select(F.struct(
        F.count(F.lit(1)).alias("n_pub"),
        F.count_if(F.col("type").isin(*rules.DASHBOARD_TYPES)).alias("n_dash"))).scalar()
    st = state.join(pub, "product_id", "left_semi").groupBy("requester_id").agg(
        F.count_if(F.col("state") == "granted").alias("n_granted"),
        F.count_if(F.col("state").isin("revoked", "pending")).alias("n_blocked"),
    )
    u = users.select(F.col("user_id").alias("requester_id"), (normalize_role("role") == "admin").alias("is_admin"))
    j = u.join(st, "requester_id", "left").fillna(0, ["n_granted", "n_blocked"]).withColumn("_t", totals)
    n_pub, n_dash = F.col("_t.n_pub"), F.col("_t.n_dash")
    accessible = F.when(F.col("is_admin"), n_pub - F.col("n_blocked")).otherwise(F.col("n_granted"))
    return j.withColumn("accessible", accessible).select(
        F.col("requester_id").alias("user_id"),
        "accessible",
        (n_pub - F.col("accessible")).alias("requestable"),
        n_dash.alias("dashboards"),
        (n_pub - n_dash).alias("other_products"),
    )


def accessible_vs_restricted(state: DataFrame, published: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """U4: the published catalog split for one user by can_query."""
    mine = state.filter(F.col("requester_id") == user_id).select("product_id", "state")
    fallback = F.lit("admin" if is_admin else "none")
    j = published.select("product_id", "product_ref", "display_name").join(mine, "product_id", "left")
    st = F.coalesce(F.col("state"), fallback)
    return j.select("product_id", "product_ref", "display_name", st.alias("state"),
                    st.isin("granted", "admin").alias("accessible"))


def approvable(decisions: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """A decision may approve only when the approver is not the requester
    (case-insensitive) and the request is Pending; otherwise a reason."""
    req = requests.select("request_id", "requester_id", "status").join(
        users.select(F.col("user_id").alias("requester_id"), F.col("email").alias("requester_email")),
        "requester_id", "left")
    j = decisions.join(req, "request_id", "inner")
    self_appr = F.lower(F.col("requester_email")) == F.lower(F.col("approver_email"))
    reason = (
        F.when(F.coalesce(self_appr, F.lit(False)), "self_approval")
        .when(F.col("status").isNotNull() & (F.col("status") != "Pending"), F.concat(F.lit("already_"), F.lower("status")))
        .otherwise(F.lit(None).cast("string"))
    )
    return j.select("request_id", "approver_email", "status", reason.alias("reason"),
                    reason.isNull().alias("approvable"))


def open_request_check(submitted: DataFrame, requests: DataFrame) -> DataFrame:
    """For submitted (user_id, product_id) pairs, does a request exist.
    Existing pairs are reduced by a distinct aggregate before the join."""
    existing = requests.select(F.col("requester_id").alias("user_id"), "product_id").distinct() \
        .withColumn("has_request", F.lit(True))
    return submitted.select("user_id", "product_id").join(existing, ["user_id", "product_id"], "left") \
        .select("user_id", "product_id", F.coalesce("has_request", F.lit(False)).alias("has_request"))


def decision_batch(requests: DataFrame, users: DataFrame, steward_email: str,
                   self_approving_department: str = "BUILDING") -> DataFrame:
    """A decision batch derived from the requests: every request is decided by
    the steward, except that requesters of one department try to approve
    their own requests (upper-cased own e-mail, to exercise the
    case-insensitive guard)."""
    u = users.select(F.col("user_id").alias("requester_id"), F.col("email").alias("requester_email"), "department")
    return requests.select("request_id", "requester_id").join(u, "requester_id", "inner").select(
        "request_id",
        F.when(F.col("department") == self_approving_department, F.upper("requester_email"))
        .otherwise(F.lit(steward_email)).alias("approver_email"),
    )


def idle_users(users: DataFrame, listed: DataFrame, requests: DataFrame, library: DataFrame) -> DataFrame:
    """Listed users with no request made, none resolved, no library row
    (three anti joins; NULL keys can never match, unlike NOT IN)."""
    u = users.join(listed.select("user_id"), "user_id", "left_semi")
    made = requests.select(F.col("requester_id").alias("user_id"))
    out = u.join(made, "user_id", "left_anti")
    if "resolved_by" in requests.columns:
        out = out.join(requests.select(F.col("resolved_by").alias("user_id")), "user_id", "left_anti")
    return out.join(library.select("user_id"), "user_id", "left_anti")


def requests_of_placeholders(requests: DataFrame, products: DataFrame, pattern: str) -> DataFrame:
    """Requests whose product's table name matches a placeholder LIKE pattern."""
    ph = products.filter(F.col("uc_full_name").like(pattern)).select("product_id")
    return requests.join(ph, "product_id", "left_semi")


def enrich_matches(matches: DataFrame, published: DataFrame) -> DataFrame:
    """A match list (ref, reason) joined to published products by ref;
    unknown or unpublished refs drop out."""
    p = published.select(F.col("product_ref").alias("ref"), "product_id", "display_name", "domain", "type")
    return matches.join(p, "ref", "inner")


def library_dedupe(library: DataFrame, requests: DataFrame, products: DataFrame) -> DataFrame:
    """Per user, pinned items whose product has no request of that user,
    then every request of the user."""
    req = requests.select(F.col("requester_id").alias("user_id"), "product_id", "status", "request_id")
    pinned = library.select("user_id", "product_id").join(req.select("user_id", "product_id"),
                                                           ["user_id", "product_id"], "left_anti")
    items = pinned.select("user_id", "product_id", F.lit("pinned").alias("source"), F.lit("Approved").alias("status"),
                          F.lit(None).cast("string").alias("request_id")).unionByName(
        req.select("user_id", "product_id", F.lit("request").alias("source"), "status", "request_id"))
    prod = products.select("product_id", "product_ref", F.col("display_name").alias("name"))
    return items.join(prod, "product_id", "inner")
