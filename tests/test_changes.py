"""Mutations: applying the same batch twice changes nothing the second time."""

import datetime as dt

from pyspark.sql import functions as F

from stewardlake.operators import changes as CH
from stewardlake.operators import governance as G
from stewardlake.plans.params import requests_as_of
from stewardlake.sources.fixtures import tables

SF = "/root/testdata/sf0.001"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_audit_append_is_idempotent(spark):
    t = tables(spark, SF)
    ev = G.nudge_events(t.access_requests, t.users, requests_as_of())
    once = G.audit_append(t.audit_log, ev).cache()
    twice = G.audit_append(once, ev)
    assert once.count() > t.audit_log.count()
    assert same(once, twice)


def test_upsert_users_is_idempotent(spark):
    t = tables(spark, SF)
    inc = spark.createDataFrame([("NEW@x.org", "New", "analyst", "General"), ("customer.000000001@example.org", "C1", "admin", "X")],
                                "email string, display_name string, role string, department string")
    once = CH.upsert_users(t.users, inc).cache()
    twice = CH.upsert_users(once, inc)
    assert once.count() == t.users.count() + 1
    assert same(once, twice)


def test_deny_twice_same_result(spark):
    t = tables(spark, SF)
    dec = t.access_requests.filter(F.col("status") == "Pending").select(
        "request_id", F.lit("s@x").alias("approver_email"), F.lit("stale").alias("reason"))
    once = CH.deny_requests(t.access_requests, t.users, dec, requests_as_of()).cache()
    twice = CH.deny_requests(once, t.users, dec, requests_as_of())
    assert same(once, twice)


def test_sequence_numbers_are_consecutive(spark):
    from stewardlake.operators.common import sequence_numbers

    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = sequence_numbers(df, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert [r["k"] for r in got] == list(range(5000))


def test_more_changes_are_idempotent(spark):
    from stewardlake.operators import access as A
    from stewardlake.plans.params import STEWARD_EMAIL

    t = tables(spark, SF)
    as_of = requests_as_of()
    dec = A.decision_batch(t.access_requests, t.users, STEWARD_EMAIL)
    once = CH.approve_requests(t.access_requests, t.users, t.data_products, dec, as_of).cache()
    assert same(once, CH.approve_requests(once, t.users, t.data_products, dec, as_of))

    rev = t.access_requests.filter(F.col("business_reason") == "1-URGENT").select("request_id", F.lit(None).cast("string").alias("reason"))
    r1 = CH.revoke_requests(once, rev, as_of).cache()
    assert same(r1, CH.revoke_requests(r1, rev, as_of))

    p = t.data_products
    dec_p = p.filter(F.col("status") == "Pending").select(
        "product_ref", F.when(F.col("type") == "Dataset", "publish").otherwise("reject").alias("action"), as_of.alias("decided_at"))
    p1 = CH.review_products(p, dec_p, as_of).cache()
    assert same(p1, CH.review_products(p1, dec_p, as_of))

    patches = p.filter(F.col("type") == "Report").select(
        "product_ref", F.lit(True).alias("has_domain"), F.lower("domain").alias("domain"))
    q1 = CH.patch_products(p, patches).cache()
    assert same(q1, CH.patch_products(q1, patches))

    inc = t.raw("customer").select(F.col("c_mktsegment").alias("group_name"), F.lit("analyst").alias("role")).distinct()
    g1 = CH.upsert_groups(t.portal_groups, inc).cache()
    assert same(g1, CH.upsert_groups(g1, inc))


def test_decision_outcomes_note_unexpected_states(spark):
    req = spark.createDataFrame([("a", "Pending"), ("b", "Approved"), ("c", "Denied"), ("d", "Approved")],
                                "request_id string, status string")
    dec = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "request_id string")
    deny = {r["request_id"]: r["note"] for r in CH.decision_outcomes(req, dec, "deny").collect()}
    assert deny == {"a": None, "b": "was_approved", "c": "was_denied"}
    revoke = {r["request_id"]: r["note"] for r in CH.decision_outcomes(req, dec, "revoke").collect()}
    assert revoke == {"a": "was_pending", "b": None, "c": "was_denied"}


def test_latest_per_key_folds_a_batch(spark):
    from stewardlake.operators.common import latest_per_key

    df = spark.createDataFrame([("k1", 1, "a"), ("k1", 3, "c"), ("k1", 2, "b"), ("k2", 5, "z")],
                               "key string, seq long, value string")
    got = {r["key"]: r["value"] for r in latest_per_key(df, ["key"], [F.col("seq")], ["value"]).collect()}
    assert got == {"k1": "c", "k2": "z"}
    edits = spark.createDataFrame([(1, "", "HR", "", 1), (1, "admin", "", "", 2)],
                                  "user_id long, role string, department string, display_name string, edit_seq long")
    users = spark.createDataFrame([(1, "a@x", "Ann", "analyst", "Sales")],
                                  "user_id long, email string, display_name string, role string, department string")
    row = CH.edit_users(users, edits).first()
    # each field comes from the last edit that supplies it; empty fields change nothing
    assert (row["role"], row["department"], row["display_name"]) == ("admin", "HR", "Ann")


def test_batches_fold_by_time_and_guards_come_first(spark):
    """Several changes of one key, the older one textually larger."""
    as_of = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    users = spark.createDataFrame([(1, "zed@x", "Zed", "viewer", "S"), (2, "adm@x", "Adm", "admin", "S"), (3, "ADM@x", "Other", "admin", "S")],
                                  "user_id long, email string, display_name string, role string, department string")
    req = spark.createDataFrame([("r1", 7, 1, "Pending"), ("r2", 7, 1, "Approved")],
                                "request_id string, product_id long, requester_id long, status string").withColumns(
        {c: F.lit(None).cast("timestamp_ntz") for c in ("resolved_at", "expires_at")})
    products = spark.createDataFrame([(7, "DP-001", "Name", "c.s.t", "z")],
                                     "product_id long, product_ref string, display_name string, uc_full_name string, domain string")
    dec = spark.createDataFrame([("r1", "zed@x", 1), ("r1", "adm@x", 2), ("r1", "zz@x", 3)],
                                "request_id string, approver_email string, decided_at int")
    out = CH.approvals(req, users, products, dec, as_of)
    rows = {r["request_id"]: r for r in out["access_requests"].collect()}
    assert (rows["r1"]["status"], rows["r1"]["resolved_by"]) == ("Approved", 2) and len(rows) == 2
    assert [(r["event_type"], r["actor_email"], r["target_name"]) for r in out["audit"].collect()] == [("REQUEST_APPROVED", "adm@x", "r1")]

    deny = spark.createDataFrame([("r1", "adm@x", "zz", 1), ("r1", "adm@x", "aa", 2)],
                                 "request_id string, approver_email string, reason string, decided_at int")
    denied = CH.denials(req, users, deny, as_of)
    assert [(r["status"], r["denial_reason"]) for r in denied["access_requests"].where("request_id = 'r1'").collect()] == [("Denied", "aa")]
    assert denied["audit"].count() == 1

    inc = spark.createDataFrame([("zed@x", "zz old", "viewer", "A", 1), ("Zed@x ", "New", "Data Steward", None, 2)],
                                "email string, display_name string, role string, department string, upsert_seq int")
    got = {r["user_id"]: r for r in CH.upsert_users(users, inc).collect()}
    assert (got[1]["display_name"], got[1]["role"], got[1]["department"]) == ("New", "admin", "")

    patches = spark.createDataFrame([("DP-001", 1, True, "zz", True, "Old"), ("DP-001", 2, True, "aa", False, None)],
                                    "product_ref string, patch_seq int, has_domain boolean, domain string, has_display_name boolean, display_name string")
    p = CH.patch_products(products, patches, as_of).collect()
    assert [(r["domain"], r["display_name"]) for r in p] == [("aa", "Old")] and p[0]["updated_at"] is not None


def test_audit_append_keeps_later_events_and_skips_repeats(spark):
    from stewardlake.operators.governance import audit_append

    schema = "log_id long, event_type string, actor_id long, metadata string, occurred_at timestamp_ntz"
    jan, feb = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    audit = spark.createDataFrame([(5, "NUDGE_SENT", 1, "{}", jan)], schema)
    new = spark.createDataFrame([("NUDGE_SENT", 1, "{}", feb), ("NUDGE_SENT", 1, "{}", feb), ("NUDGE_SENT", 1, "{}", jan)],
                                schema.replace("log_id long, ", ""))
    assert sorted((r["log_id"], r["occurred_at"]) for r in audit_append(audit, new).collect()) == [(5, jan), (6, feb)]


def test_product_words_past_the_sixtieth_name_match(spark):
    from stewardlake.operators.search import match_questions

    products = spark.createDataFrame([(i, f"name {i:03d}", "Other", ["x"], "straße éclair" if i == 99 else "") for i in range(100)],
                                     "product_id long, display_name string, domain string, tags array<string>, description string")
    qs = spark.createDataFrame([(1, 0, "Where is the ÉCLAIR of the Straße?"), (2, 0, "nothing here")], "conv_id long, turn int, text string")
    assert [(r["conv_id"], r["product_id"], r["shared_words"]) for r in match_questions(qs, products).collect()] == [(1, 99, 2)]


def test_demo_reset(spark):
    req = spark.createDataFrame([(1, "Pending")], "request_id long, status string")
    log = spark.createDataFrame([(1, "PRODUCT_PUBLISHED"), (2, "NUDGE_SENT")], "log_id long, event_type string")
    lib = spark.createDataFrame([(1, 1)], "user_id long, product_id long")
    prods = spark.createDataFrame(
        [("DP-001", "Pending"), ("DP-002", "Rejected"), ("DP-003", None), (None, "Pending"), ("DP-004", "Published")],
        "product_ref string, status string")
    users = spark.createDataFrame([(7, " Ann@Example.org", "Ann", "analyst", "HR")],
                                  "user_id long, email string, display_name string, role string, department string")
    seeds = spark.createDataFrame([("ann@example.org", "Other", "admin", "X"), ("bo@example.org", "Bo", "admin", "Y")],
                                  "email string, display_name string, role string, department string")
    out = CH.reset_demo(req, log, lib, prods, users, ["DP-001"], seeds)
    assert {r["table_name"]: r["n_rows"] for r in CH.table_counts(out).collect()} == {
        "access_requests": 0, "audit_log": 0, "user_library": 0, "data_products": 4, "users": 2}
    assert {r["product_ref"] for r in out["data_products"].collect()} == {"DP-001", "DP-003", None, "DP-004"}
    assert sorted(tuple(r) for r in out["users"].collect()) == [
        (7, " Ann@Example.org", "Ann", "analyst", "HR"), (8, "bo@example.org", "Bo", "admin", "Y")]
    again = CH.reset_demo(*[out[k] for k in ("access_requests", "audit_log", "user_library", "data_products", "users")],
                          ["DP-001"], seeds)
    assert all(same(out[k], again[k]) for k in out)
    nothing = CH.reset_demo(*[f.limit(0) for f in (req, log, lib, prods, users)], ["DP-001"], seeds)
    assert [r["user_id"] for r in nothing["users"].sort("user_id").collect()] == [1, 2]
