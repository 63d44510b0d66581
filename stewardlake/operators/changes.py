"""Table changes as snapshot functions.

Parquet has no UPDATE / DELETE / MERGE, so each change is a pure function
``(current, changes, as_of) -> new snapshot`` built from joins, anti joins and
unions, which the caller writes as a new table version. With a transactional
table format the same plan is one MERGE.

* Batches carry a time or sequence column. Several changes to one key are
  folded to the latest (per field where a change is partial) before they are
  applied (partial aggregates, skew-safe); a guard is applied before the fold.
* New ids come from the business key (md5 text ids) or continue after the
  current maximum (``sequence_numbers``), never from ``uuid()``, so a retried
  job produces the same rows.
* Applying the same batch twice changes nothing the second time, except for
  registrations, which have no business key (each one is a new product).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import normalize_role
from ..functions.grants import audit_metadata, grant_sql, revoke_sql
from ..functions.text import tags_from_input, word_caps
from ..sources.fixtures import days
from .common import latest_per_key, sequence_numbers
from .metadata import assign_refs
from .refusals import accepted, judge_registrations, judge_requests, refused

WORKFLOW_EVENTS = ["REQUEST_SUBMITTED", "REQUEST_APPROVED", "REQUEST_DENIED", "ACCESS_REVOKED", "NUDGE_SENT"]


def _nz(c: str) -> Column:
    """Empty text counts as absent."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


# ---- products -------------------------------------------------------------------------------
def register_products(products: DataFrame, submissions: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """M1: valid submissions (non-empty name and description) become inactive
    Pending products with defaults; refs continue after the current maximum
    in submission order; one PRODUCT_SUBMITTED audit row each. The others are
    ``refused``, with their reasons."""
    judged = judge_registrations(submissions)
    ok = accepted(judged)
    rows = ok.select(
        "submission_id",
        F.col("name").alias("display_name"), "description",
        F.coalesce(_nz("type"), F.lit("Dashboard")).alias("type"),
        F.coalesce(_nz("source"), F.lit("Other")).alias("source_system"),
        F.coalesce(tags_from_input(F.col("tags")), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(_nz("refresh_frequency"), F.lit("Daily")).alias("refresh_frequency"),
        F.coalesce(_nz("owner_email"), _nz("submitted_by"), F.lit("unknown@example.org")).alias("owner_email"),
        F.lit("Internal").alias("classification"),
        F.lit("").alias("uc_full_name"),
        F.coalesce(_nz("domain"), _nz("source"), F.lit("Other")).alias("domain"),
        F.lit(False).alias("is_active"),
        F.lit("Pending").alias("status"),
        F.coalesce(_nz("submitted_by"), _nz("owner_email"), F.lit("unknown")).alias("submitted_by"),
    )
    new = assign_refs(rows, products, order_col="submission_id")
    audit = new.select(
        F.lit("PRODUCT_SUBMITTED").alias("event_type"), F.col("submitted_by").alias("actor_email"),
        F.col("product_ref").alias("target_name"),
        audit_metadata(name=F.col("display_name"), productRef=F.col("product_ref")).alias("metadata"),
        as_of.alias("occurred_at"))
    return {"new_products": new.drop("submission_id", "submitted_by"), "audit": audit, "refused": refused(judged)}


def review_products(products: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """M2: publish (active + Published) or reject (status only) by ref;
    updated_at = as_of on touched rows. Latest decision per ref wins."""
    dec = latest_per_key(decisions, ["product_ref"], [F.col("decided_at")], ["action"])
    j = products.join(dec, "product_ref", "left")
    act = F.col("action")
    out = j.withColumn("is_active", F.when(act == "publish", F.lit(True)).otherwise(F.col("is_active"))) \
        .withColumn("status", F.when(act == "publish", "Published").when(act == "reject", "Rejected").otherwise(F.col("status")))
    if "updated_at" not in products.columns:
        out = out.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return out.withColumn("updated_at", F.when(act.isin("publish", "reject"), as_of).otherwise(F.col("updated_at"))) \
        .drop("action")


#: Patchable fields: product column and the name of the field in a patch.
PATCHABLE = {
    "display_name": "display_name", "description": "description", "uc_full_name": "uc_full_name",
    "source_system": "source_type", "refresh_frequency": "refresh_frequency", "report_url": "report_url",
    "domain": "domain", "owner_email": "owner_email", "classification": "data_classification", "tags": "tags",
}


def _sequence(df: DataFrame, name: str) -> Column:
    """The batch's order column, or a constant where a batch has one change per key."""
    return F.col(name) if name in df.columns else F.lit(0)


def patch_products(products: DataFrame, patches: DataFrame, as_of: Column | None = None) -> DataFrame:
    """M3: update only supplied fields. ``patches`` has product_ref, patch_seq
    and, per field f, ``f`` and a presence flag ``has_f`` (an explicit NULL is a
    value). Of several patches of a product the latest that supplies a field
    sets it. ``as_of`` becomes updated_at of patched products."""
    fields = {c: f for c, f in PATCHABLE.items() if f"has_{f}" in patches.columns}
    for c in fields:
        if c not in products.columns:
            products = products.withColumn(c, F.lit(None).cast(patches.schema[fields[c]].dataType))
    seq = _sequence(patches, "patch_seq").alias("s")
    folded = patches.groupBy("product_ref").agg(F.lit(True).alias("_hit"), *[
        F.max(F.when(F.coalesce(F.col(f"has_{f}"), F.lit(False)), F.struct(seq, F.col(f).alias("v")))).alias(f"_p_{c}")
        for c, f in fields.items()])
    if as_of is not None and "updated_at" not in products.columns:
        products = products.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    j = products.join(folded, "product_ref", "left")
    touched = F.lit(False)
    for c in fields:
        touched = touched | F.col(f"_p_{c}").isNotNull()
    new = {c: F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(c)) for c in fields}
    if as_of is not None:
        new["updated_at"] = F.when(touched, as_of).otherwise(F.col("updated_at"))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in products.columns])


def delete_products(refs: DataFrame, products: DataFrame, requests: DataFrame, audit: DataFrame,
                    library: DataFrame) -> dict[str, DataFrame]:
    """M4: drop the products, their requests, their audit rows and (unlike the
    reference, which the foreign key would reject) their library rows. An
    audit row is about a product by its target name or by the reference or
    product key in its metadata."""
    gone = products.join(refs.select("product_ref").distinct(), "product_ref", "left_semi").select("product_id")
    about = F.get_json_object("metadata", "$.k").try_cast("bigint")
    named = [F.col("target_name")] if "target_name" in audit.columns else []
    ref = F.coalesce(*named, F.get_json_object("metadata", "$.productRef"), F.get_json_object("metadata", "$.ref"))
    gone_ids = gone.withColumnRenamed("product_id", "_pid")
    gone_refs = refs.select(F.col("product_ref").alias("_ref")).distinct()
    kept = audit.withColumn("_pid", about).withColumn("_ref", ref).join(gone_ids, "_pid", "left_anti").join(
        gone_refs, "_ref", "left_anti")
    return {
        "data_products": products.join(gone, "product_id", "left_anti"),
        "access_requests": requests.join(gone, "product_id", "left_anti"),
        "audit_log": kept.select(*audit.columns),
        "user_library": library.join(gone, "product_id", "left_anti"),
    }


def fill_defaults(products: DataFrame) -> DataFrame:
    """Status NULL -> Published, source_system NULL -> the default source."""
    return products.withColumn("status", F.coalesce("status", F.lit("Published"))) \
        .withColumn("source_system", F.coalesce("source_system", F.lit(rules.DEFAULT_SOURCE_TYPE)))


def _seeded_or_decided(seed_refs: list[str]) -> Column:
    """Products a reset keeps: all but Pending / Rejected ones off the seed list. A null
    status counts as Published; without a reference a product is on no list and stays."""
    open_ = F.coalesce("status", F.lit("Published")).isin("Pending", "Rejected")
    return ~F.coalesce(open_ & ~F.col("product_ref").isin(*seed_refs), F.lit(False))


def reset_workflow(requests: DataFrame, audit: DataFrame, products: DataFrame, seed_refs: list[str]) -> dict[str, DataFrame]:
    """Remove all requests and the workflow audit events; drop Pending /
    Rejected products that are not in the seed list."""
    return {
        "access_requests": requests.filter(F.lit(False)),
        "audit_log": audit.filter(~F.col("event_type").isin(*WORKFLOW_EVENTS)),
        "data_products": products.filter(_seeded_or_decided(seed_refs)),
    }


def reset_demo(requests: DataFrame, audit: DataFrame, library: DataFrame, products: DataFrame, users: DataFrame,
               seed_refs: list[str], seed_users: DataFrame) -> dict[str, DataFrame]:
    """M19, demo reset: requests, the whole audit log and every library are emptied, Pending /
    Rejected products off the seed list go, and seed users (email, display_name, role, department)
    are added where their e-mail is missing; nobody is changed or removed. Empty tables stay empty
    but for the seed users."""
    return {
        "access_requests": requests.filter(F.lit(False)),
        "audit_log": audit.filter(F.lit(False)),
        "user_library": library.filter(F.lit(False)),
        "data_products": products.filter(_seeded_or_decided(seed_refs)),
        "users": upsert_users(users, seed_users, mode="insert_if_absent"),
    }


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows): one row per table, counted in each task and summed."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in frames.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# ---- requests -------------------------------------------------------------------------------
def default_display_name(email: Column) -> Column:
    """Name for a user created on submit: local part, the first '.' to a blank,
    words capitalised."""
    local = F.substring_index(email, "@", 1)
    return word_caps(F.regexp_replace(local, r"^([^.]*)\.", "$1 "))


def submit_requests(requests: DataFrame, users: DataFrame, products: DataFrame, submissions: DataFrame,
                    as_of: Column) -> dict[str, DataFrame]:
    """M5: submissions (submission_id, product_ref, requester_email, team,
    reason) for known products become Pending requests; unknown e-mails are
    inserted as analysts of 'General' first; team defaults to the user's
    department. request_id = md5 of the business key. Submissions without a
    product, an e-mail or a reason, or for an unknown product, are ``refused``."""
    judged = judge_requests(submissions, products)
    known = accepted(judged)
    new_users = upsert_users(
        users,
        known.select(F.col("requester_email").alias("email"), default_display_name(F.col("requester_email")).alias("display_name"),
                     F.lit("analyst").alias("role"), F.lit("General").alias("department")),
        mode="insert_if_absent")
    u = new_users.select(F.lower(F.trim("email")).alias("_e"), F.col("user_id").alias("requester_id"), "department")
    j = known.join(u, F.lower(F.trim(known.requester_email)) == u._e, "inner")
    new_req = j.select(
        F.md5(F.concat_ws("|", F.col("requester_email"), F.col("product_ref"), F.col("submission_id").cast("string"))).alias("request_id"),
        "product_id", "requester_id",
        F.col("reason").alias("business_reason"),
        F.lit("Pending").alias("status"),
        as_of.alias("requested_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
        F.coalesce(_nz("team"), F.col("department")).alias("requester_team"),
        "requester_email",
    )
    fresh = new_req.join(requests.select("request_id"), "request_id", "left_anti")
    audit = fresh.select(
        F.lit("REQUEST_SUBMITTED").alias("event_type"), "requester_email", "request_id", as_of.alias("occurred_at"))
    return {"access_requests": requests.unionByName(fresh.drop("requester_email"), allowMissingColumns=True),
            "new_requests": fresh.drop("requester_email"), "users": new_users, "audit": audit, "refused": refused(judged)}


def _with_resolution_cols(requests: DataFrame) -> DataFrame:
    for c, t in [("resolved_by", "bigint"), ("denial_reason", "string"), ("uc_grant_sql", "string"),
                 ("uc_grant_issued", "boolean"), ("updated_at", "timestamp_ntz")]:
        if c not in requests.columns:
            requests = requests.withColumn(c, F.lit(None).cast(t))
    return requests


def one_decision_per_request(decisions: DataFrame, cols: list[str]) -> DataFrame:
    """Fold a batch to the latest decision per request id (by ``decided_at``,
    ties to the largest ``cols`` tuple), so a repeated decision cannot multiply rows."""
    return latest_per_key(decisions, ["request_id"], [_sequence(decisions, "decided_at"), *[F.col(c) for c in cols]], cols)


#: Shares of the decisions of one approver.
APPROVER_SHARES = 64


def _approver_ids(decisions: DataFrame, users: DataFrame) -> DataFrame:
    """Adds ``_approver_id``: the user with exactly the approver's e-mail. The
    few different approvers are resolved first, so that one steward who decides
    everything is one row of the join with users. Their decisions are joined in
    shares, so that they are no single task either."""
    asked = decisions.select(F.col("approver_email").alias("_ae")).distinct()
    found = asked.join(users, asked._ae == users.email, "inner").groupBy("_ae").agg(F.min("user_id").alias("_approver_id"))
    shared = found.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(APPROVER_SHARES - 1))))
    split = decisions.withColumn("_split", F.pmod(F.xxhash64("request_id"), F.lit(APPROVER_SHARES)).cast("int"))
    return split.join(shared, (split.approver_email == shared._ae) & (split._split == shared._share), "left").drop("_ae", "_share", "_split")


def _decision_audit(event: str, decided: DataFrame, metadata: Column, as_of: Column) -> DataFrame:
    """One audit row per decided request (request_id, _actor)."""
    return decided.select(F.lit(event).alias("event_type"), F.col("_actor").alias("actor_email"),
                          F.col("request_id").alias("target_name"), metadata.alias("metadata"), as_of.alias("occurred_at"))


def _updated(req: DataFrame, joined: DataFrame, hit: Column, new: dict[str, Column]) -> DataFrame:
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in req.columns])


def approvals(requests: DataFrame, users: DataFrame, products: DataFrame, decisions: DataFrame,
              as_of: Column) -> dict[str, DataFrame]:
    """M6: approvals that pass the G3 guard (approver is not the requester,
    case-insensitive; request still Pending) set Approved, resolved_at /
    updated_at = as_of, resolved_by (approver's user id or NULL), the grant
    text, grant issued, and expires_at = as_of + 90 days. Failed guards change
    nothing: the guard is applied first, then the earliest valid decision of a
    request (by ``decided_at``) counts. One REQUEST_APPROVED audit row each."""
    req = _with_resolution_cols(requests)
    pending = F.col("status").isNull() | (F.col("status") == "Pending")
    open_ = req.where(pending).select("request_id", "requester_id", "product_id").join(
        users.select(F.col("user_id").alias("requester_id"), F.col("email").alias("_remail")), "requester_id", "left")
    valid = decisions.where(F.col("approver_email").isNotNull()).join(open_, "request_id", "inner").where(
        ~F.coalesce(F.lower("_remail") == F.lower("approver_email"), F.lit(False)))
    first = valid.groupBy("request_id").agg(F.min(F.struct(
        _sequence(decisions, "decided_at").alias("at"), "approver_email", "product_id", "_remail")).alias("d"))
    named = _approver_ids(first.select("request_id", "d.approver_email", "d.product_id", "d._remail"), users).join(
        products.select("product_id", F.col("uc_full_name").alias("_full"), F.col("display_name").alias("_pname")),
        "product_id", "left")
    granted = named.select("request_id", F.col("approver_email").alias("_actor"), "_approver_id",
                           grant_sql("_full", "_remail", "_pname").alias("_grant"), F.lit(True).alias("_hit"))
    out = _updated(req, req.join(granted, "request_id", "left"), F.coalesce("_hit", F.lit(False)), {
        "status": F.lit("Approved"), "resolved_at": as_of, "resolved_by": F.col("_approver_id"),
        "uc_grant_issued": F.lit(True), "uc_grant_sql": F.col("_grant"), "updated_at": as_of,
        "expires_at": as_of + days(rules.APPROVAL_VALID_DAYS)})
    audit = _decision_audit("REQUEST_APPROVED", granted, audit_metadata(ucGrantSql=F.col("_grant")), as_of)
    return {"access_requests": out, "audit": audit}


def approve_requests(requests: DataFrame, users: DataFrame, products: DataFrame, decisions: DataFrame,
                     as_of: Column) -> DataFrame:
    """M6: the new request table (see ``approvals``)."""
    return approvals(requests, users, products, decisions, as_of)["access_requests"]


def denials(requests: DataFrame, users: DataFrame, decisions: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """M7: Denied with reason, resolver and time; no Pending guard (parity).
    The latest decision of a request counts. One REQUEST_DENIED audit row each."""
    req = _with_resolution_cols(requests)
    last = one_decision_per_request(decisions, ["approver_email", "reason"]).join(
        req.select("request_id"), "request_id", "left_semi")
    d = _approver_ids(last, users).select("request_id", "_approver_id", F.col("approver_email").alias("_actor"),
                                          F.coalesce("reason", F.lit("")).alias("_reason"), F.lit(True).alias("_hit"))
    out = _updated(req, req.join(d, "request_id", "left"), F.coalesce("_hit", F.lit(False)), {
        "status": F.lit("Denied"), "resolved_at": as_of, "resolved_by": F.col("_approver_id"),
        "denial_reason": F.col("_reason"), "updated_at": as_of})
    return {"access_requests": out,
            "audit": _decision_audit("REQUEST_DENIED", d, audit_metadata(reason=F.col("_reason")), as_of)}


def deny_requests(requests: DataFrame, users: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """M7: the new request table (see ``denials``)."""
    return denials(requests, users, decisions, as_of)["access_requests"]


def revocations(requests: DataFrame, decisions: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """M8: Revoked with reason (default text), resolved_at, the REVOKE text
    derived from the grant text; expires_at is kept. The latest decision of a
    request counts. One ACCESS_REVOKED audit row each."""
    req = _with_resolution_cols(requests)
    if "approver_email" not in decisions.columns:
        decisions = decisions.withColumn("approver_email", F.lit(None).cast("string"))
    last = one_decision_per_request(decisions, ["reason", "approver_email"])
    d = last.select("request_id", F.coalesce(_nz("reason"), F.lit(rules.DEFAULT_REVOKE_REASON)).alias("_reason"),
                    F.col("approver_email").alias("_actor"), F.lit(True).alias("_hit"))
    out = _updated(req, req.join(d, "request_id", "left"), F.coalesce("_hit", F.lit(False)), {
        "status": F.lit("Revoked"), "resolved_at": as_of, "denial_reason": F.col("_reason"),
        "uc_grant_sql": revoke_sql("uc_grant_sql"), "updated_at": as_of})
    named = req.join(d.select("request_id"), "request_id", "left_semi")  # the few decided ones, before they are grouped
    grants = named.groupBy("request_id").agg(F.max(F.struct("uc_grant_sql"))["uc_grant_sql"].alias("uc_grant_sql"))
    told = d.join(grants, "request_id", "inner").withColumn("_revoke", revoke_sql("uc_grant_sql"))
    return {"access_requests": out, "audit": _decision_audit(
        "ACCESS_REVOKED", told, audit_metadata(reason=F.col("_reason"), revokeSql=F.col("_revoke")), as_of)}


def revoke_requests(requests: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """M8: the new request table (see ``revocations``)."""
    return revocations(requests, decisions, as_of)["access_requests"]


def review_audit(products: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """M2: one PRODUCT_PUBLISHED / PRODUCT_REJECTED audit row per reviewed
    product (the latest decision per ref)."""
    for c in ("reviewer_email", "reason"):
        if c not in decisions.columns:
            decisions = decisions.withColumn(c, F.lit(None).cast("string"))
    dec = latest_per_key(decisions, ["product_ref"], [F.col("decided_at")], ["action", "reviewer_email", "reason"])
    j = dec.join(products.select("product_ref", "display_name"), "product_ref", "inner")
    publish = F.col("action") == "publish"
    return j.where(F.col("action").isin("publish", "reject")).select(
        F.when(publish, "PRODUCT_PUBLISHED").otherwise("PRODUCT_REJECTED").alias("event_type"),
        F.coalesce("reviewer_email", F.lit("admin")).alias("actor_email"), F.col("product_ref").alias("target_name"),
        F.when(publish, audit_metadata(ref=F.col("product_ref"), name=F.col("display_name")))
        .otherwise(audit_metadata(ref=F.col("product_ref"), reason=F.col("reason"))).alias("metadata"),
        as_of.alias("occurred_at"))


# ---- users and groups ---------------------------------------------------------------------------
def upsert_users(users: DataFrame, incoming: DataFrame, mode: str = "overwrite") -> DataFrame:
    """key = lower(trim(email)). ``overwrite`` replaces name, normalized
    role and department of existing users (absent name or department: empty);
    ``insert_if_absent`` only adds new ones. Of several rows of one e-mail the
    latest by ``upsert_seq`` counts. New users get ids after the current
    maximum, in e-mail order."""
    inc = incoming.withColumn("_k", F.lower(F.trim("email"))).withColumn("role", normalize_role("role"))
    inc = inc.withColumns({c: F.coalesce(c, F.lit("")) for c in ("display_name", "department")})
    inc = latest_per_key(inc, ["_k"], [_sequence(inc, "upsert_seq"), F.col("email")], ["display_name", "role", "department"])
    cur = users.withColumn("_k", F.lower(F.trim("email")))
    if mode == "overwrite":
        hit = inc.select(*[F.col(c).alias(f"_n_{c}") for c in ["_k", "display_name", "role", "department"]])
        upd = cur.join(hit, cur._k == hit._n__k, "left")
        found = F.col("_n__k").isNotNull()
        cur = upd.select(*[
            F.when(found, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in ("display_name", "role", "department") else F.col(c)
            for c in cur.columns])
    new = inc.join(cur.select("_k"), "_k", "left_anti")
    base = users.select(F.coalesce(F.max("user_id"), F.lit(0)).alias("m")).scalar()
    new = sequence_numbers(new, ["_k"], "_seq").select(
        (base + F.col("_seq")).alias("user_id"), F.col("_k").alias("email"), "display_name", "role", "department")
    return cur.drop("_k").unionByName(new, allowMissingColumns=True)


def upsert_groups(groups: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or overwrite group rows by group name (the latest by ``upsert_seq``)."""
    inc = latest_per_key(incoming, ["group_name"], [_sequence(incoming, "upsert_seq"), F.col("role")], ["role"])
    kept = groups.join(inc.select("group_name"), "group_name", "left_anti")
    return kept.unionByName(inc.select(*groups.columns))


def upsert_settings(settings: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """Key-value upsert with updated_at (the latest by ``upsert_seq``)."""
    inc = latest_per_key(incoming, ["key"], [_sequence(incoming, "upsert_seq"), F.col("value")], ["value"]).withColumn("updated_at", as_of)
    return settings.join(inc.select("key"), "key", "left_anti").unionByName(inc.select(*settings.columns))


def migrate_roles(users: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """Users steward / data_steward -> admin, manager -> analyst;
    groups: all three -> admin (parity with the reference)."""
    def remap(col: Column, mapping: dict[str, str]) -> Column:
        e = None
        for k, v in mapping.items():
            e = F.when(col == k, v) if e is None else e.when(col == k, v)
        return e.otherwise(col)

    return {
        "users": users.withColumn("role", remap(F.col("role"), rules.USER_ROLE_MIGRATION)),
        "portal_groups": groups.withColumn("role", remap(F.col("role"), rules.GROUP_ROLE_MIGRATION)),
    }


def resolve_roles(users: DataFrame, admin_emails: DataFrame, group_roles: DataFrame) -> DataFrame:
    """Per user, the admin list wins, then the group role, then the
    stored role; all normalized to admin / analyst."""
    adm = admin_emails.select(F.lower(F.trim("email")).alias("_e")).distinct().withColumn("_listed", F.lit(True))
    j = users.withColumn("_e", F.lower(F.trim("email"))).join(adm, "_e", "left").join(
        group_roles.select("user_id", "group_role"), "user_id", "left")
    role = F.when(F.coalesce("_listed", F.lit(False)), F.lit("admin")) \
        .when(F.col("group_role").isNotNull(), normalize_role("group_role")) \
        .otherwise(normalize_role("role"))
    return j.select("user_id", "email", "role", "group_role", role.alias("resolved_role"))


def edit_users(users: DataFrame, edits: DataFrame) -> DataFrame:
    """Partial edit of role (normalized), department and name by user_id;
    empty values are ignored. Of several edits of one user the latest by
    edit_seq that supplies a field sets it."""
    fields = ("role", "department", "display_name")
    e = edits.withColumns({c: _nz(c) for c in fields}).withColumn(
        "role", F.when(F.col("role").isNotNull(), normalize_role("role")))
    e = e.groupBy("user_id").agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("edit_seq", c)))[c].alias(f"_e_{c}") for c in fields])
    j = users.join(e, "user_id", "left")
    return j.select(*[F.coalesce(F.col(f"_e_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in users.columns])


def delete_groups(groups: DataFrame, names: DataFrame) -> DataFrame:
    """Drop groups by name."""
    return groups.join(names.select("group_name"), "group_name", "left_anti")


def decision_outcomes(requests: DataFrame, decisions: DataFrame, action: str) -> DataFrame:
    """Deny and revoke accept a request in any state (as the reference); this
    report states, per decision, the status it replaced and a note when that
    status is not the one the action expects (Pending for deny, Approved for
    revoke)."""
    expected = {"deny": "Pending", "revoke": "Approved"}[action]
    dec = decisions.select("request_id").distinct()
    prior = requests.select("request_id", F.col("status").alias("prior_status"))
    return dec.join(prior, "request_id", "inner").select(
        "request_id", "prior_status", F.lit(action).alias("action"),
        F.when(F.col("prior_status") != expected, F.concat(F.lit("was_"), F.lower("prior_status"))).alias("note")
    ).distinct()
