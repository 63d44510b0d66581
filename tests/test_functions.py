"""Unit tables with literal rows for the rule functions and per-key logic."""

import datetime as dt
import math

from pyspark.sql import functions as F

from stewardlake.functions.classify import classify_sensitivity, elevated_pii, freshness, infer_domain, normalize_role
from stewardlake.functions.grants import grant_sql, revoke_sql
from stewardlake.functions.text import display_name, is_question, name_from_email, parse_tags, strip_markdown
from stewardlake.operators import access as A
from stewardlake.operators import changes as CH
from stewardlake.operators import demand as D
from stewardlake.operators import governance as G
from stewardlake.operators import search as S
from stewardlake.sources.fixtures import ts_ntz


def col_values(df, c):
    return [r[c] for r in df.collect()]


def test_sensitivity_tags_win_then_name_prefix(spark):
    rows = [("ssn_last4", None), ("Email_address", None), ("my_email", None), ("budget_code", None),
            ("region", {"sensitivity_level": "pii"}), ("region2", {"sensitivity": "Confidential"}),
            ("ssn", {"sensitivity_level": ""}), ("amount", None)]
    df = spark.createDataFrame(rows, "column_name string, tags map<string,string>")
    out = df.select("column_name", classify_sensitivity("column_name", F.coalesce("tags", F.create_map().cast(
        "map<string,string>"))).alias("s")).withColumn("e", elevated_pii("s", "column_name"))
    got = {r["column_name"]: (r["s"], r["e"]) for r in out.collect()}
    assert got == {"ssn_last4": ("PII", True), "Email_address": ("PII", False), "my_email": ("INTERNAL", False),
                   "budget_code": ("CONFIDENTIAL", False), "region": ("PII", False), "region2": ("CONFIDENTIAL", False),
                   "ssn": ("PII", True), "amount": ("INTERNAL", False)}


def test_domain_rules_keep_order_and_substring_quirks(spark):
    rows = [("three", "x"), ("systems", "core"), ("samples", "nyctaxi"), ("main", "payroll"), ("a", "b")]
    df = spark.createDataFrame(rows, "c string, s string")
    assert col_values(df.select(infer_domain("c", "s").alias("d")), "d") == [
        "HR", "Public Safety", "Property Tax", "Finance", "Other"]


def test_display_name_first_gold_only(spark):
    df = spark.createDataFrame([("sales_gold_orders",), ("gold_table",), ("goldfish_data",), ("GOLD_x_gold",)], "t string")
    assert col_values(df.select(display_name("t").alias("n")), "n") == ["Sales  Orders", "Table", "Goldfish Data", "X Gold"]


def test_name_from_email_and_role(spark):
    df = spark.createDataFrame([("jane.doe_x@example.org", " Data Steward "), ("bob@x.org", "manager"), ("c@x", None)],
                               "e string, r string")
    out = df.select(name_from_email("e").alias("n"), normalize_role("r").alias("r")).collect()
    assert [(r["n"], r["r"]) for r in out] == [("Jane Doe X", "admin"), ("Bob", "analyst"), ("C", "analyst")]


def test_freshness_boundaries(spark):
    base = dt.datetime(2001, 11, 4)
    rows = [(base - dt.timedelta(days=0.75), "Daily"), (base - dt.timedelta(days=0.76), "Daily"),
            (base - dt.timedelta(days=1.5), "Daily"), (base - dt.timedelta(days=3.0), "Daily"),
            (base - dt.timedelta(days=3.01), "Daily"), (None, "Weekly"), (base - dt.timedelta(days=2.9), "Hourly")]
    df = spark.createDataFrame(rows, "lr timestamp_ntz, f string")
    got = col_values(df.select(freshness("lr", "f", ts_ntz("2001-11-04 00:00:00")).alias("x")), "x")
    assert got == ["Fresh", "Recent", "Recent", "Stale", "Outdated", None, "Recent"]


def test_parse_tags_and_markdown(spark):
    df = spark.createDataFrame([('{a,"b c", ,}', "**bold** and *it*\n# Head\n- item\n  ")], "t string, m string")
    r = df.select(parse_tags("t").alias("t"), strip_markdown("m").alias("m")).first()
    assert r["t"] == ["a", "b c"]
    assert r["m"] == "bold and it\nHead\n• item"


def test_is_question(spark):
    df = spark.createDataFrame([("Show me payroll data",), ("\nwhat is it",), ("two words",), ("revenue by department now",),
                                ("hello there friend",)], "q string")
    assert col_values(df.select(is_question("q").alias("x")), "x") == [True, True, False, True, False]


def test_grant_and_revoke_text(spark):
    df = spark.createDataFrame([("cat.sch.t`x", "a@b.org", "P"), (None, "a@b.org", "Prod")], "f string, e string, n string")
    out = df.select(grant_sql("f", "e", "n").alias("g")).withColumn("r", revoke_sql("g")).collect()
    assert out[0]["g"] == "GRANT SELECT ON `cat`.`sch`.`t``x` TO `a@b.org`;"
    assert out[0]["r"] == "REVOKE SELECT ON `cat`.`sch`.`t``x` FROM `a@b.org`;"
    from stewardlake.functions.rules import NO_TABLE_GRANT_COMMENT
    assert out[1]["g"] == NO_TABLE_GRANT_COMMENT.format(name="Prod")


REQ_SCHEMA = ("request_id string, product_id long, requester_id long, status string, requested_at timestamp_ntz, "
              "resolved_at timestamp_ntz, expires_at timestamp_ntz")


def test_access_state_precedence(spark):
    d = dt.datetime
    rows = [
        # user 1 / product 1: expired approval + newer pending -> pending
        ("a", 1, 1, "Approved", d(2001, 1, 1), d(2001, 1, 2), d(2001, 3, 1)),
        ("b", 1, 1, "Pending", d(2001, 6, 1), None, None),
        # user 1 / product 2: old valid approval beats newer revoke -> granted
        ("c", 2, 1, "Approved", d(2001, 1, 1), d(2001, 1, 2), None),
        ("d", 2, 1, "Revoked", d(2001, 7, 1), d(2001, 7, 2), None),
        # user 2 (admin) / product 1: only denied -> admin ; user 3: only denied -> none
        ("e", 1, 2, "Denied", d(2001, 1, 1), d(2001, 1, 3), None),
        ("f", 1, 3, "Denied", d(2001, 1, 1), d(2001, 1, 3), None),
        # two pending: newest wins
        ("g", 3, 1, "Pending", d(2001, 1, 1), None, None),
        ("h", 3, 1, "Pending", d(2001, 2, 1), None, None),
    ]
    req = spark.createDataFrame(rows, REQ_SCHEMA)
    users = spark.createDataFrame([(1, "u1@x", "analyst"), (2, "u2@x", "Data_Steward "), (3, "u3@x", None)],
                                  "user_id long, email string, role string")
    st = A.access_state(req, users, ts_ntz("2001-08-01 00:00:00"))
    got = {(r["requester_id"], r["product_id"]): (r["state"], r["request_id"], r["can_query"]) for r in st.collect()}
    assert got == {(1, 1): ("pending", "b", False), (1, 2): ("granted", "c", True), (2, 1): ("admin", None, True),
                   (3, 1): ("none", None, False), (1, 3): ("pending", "h", False)}


def test_approvable_guard(spark):
    req = spark.createDataFrame([("r1", 1, 1, "Pending", None, None, None), ("r2", 1, 1, "Approved", None, None, None),
                                 ("r3", 1, 2, "Pending", None, None, None)], REQ_SCHEMA)
    users = spark.createDataFrame([(1, "Ann@X.org"), (2, "bo@x.org")], "user_id long, email string")
    dec = spark.createDataFrame([("r1", "ann@x.ORG"), ("r2", "s@x"), ("r3", "s@x")], "request_id string, approver_email string")
    got = {r["request_id"]: (r["approvable"], r["reason"]) for r in A.approvable(dec, req, users).collect()}
    assert got == {"r1": (False, "self_approval"), "r2": (False, "already_approved"), "r3": (True, None)}


def test_patch_explicit_null_vs_absent(spark):
    prods = spark.createDataFrame([("DP-1", "n1", "d1", "Finance", "ERP"), ("DP-2", "n2", "d2", "HR", "SAP")],
                                  "product_ref string, display_name string, description string, domain string, source_system string")
    patches = spark.createDataFrame([("DP-1", True, None, False, "zzz", True, "Snowflake")],
                                    "product_ref string, has_description boolean, description string, has_domain boolean, "
                                    "domain string, has_source_type boolean, source_type string")
    got = {r["product_ref"]: tuple(r) for r in CH.patch_products(prods, patches).collect()}
    assert got["DP-1"] == ("DP-1", "n1", None, "Finance", "Snowflake")
    assert got["DP-2"] == ("DP-2", "n2", "d2", "HR", "SAP")


def test_toggle_votes_parity(spark):
    votes = spark.createDataFrame([(1, 10), (1, 11)], "request_id long, voter_id long")
    reqs = spark.createDataFrame([(1,), (2,)], "request_id long")
    toggles = spark.createDataFrame([(1, 10), (1, 12), (1, 12), (2, 10)], "request_id long, voter_id long")
    out = D.toggle_votes(votes, toggles, reqs)
    assert sorted(tuple(r) for r in out["feature_request_votes"].collect()) == [(1, 11), (2, 10)]
    assert sorted(tuple(r) for r in out["upvotes"].collect()) == [(1, 1), (2, 1)]


def test_mask_table_levels(spark):
    df = spark.createDataFrame([(1, "1234", "a@b", "BC-1", 2.5)],
                               "id long, ssn_last4 string, email_address string, budget_code string, amount double")
    classes = G.column_classes(df)
    none = G.mask_table(df, classes, "none").first()
    std = G.mask_table(df, classes, "standard").first()
    strict = G.mask_table(df.withColumn("new_col", F.lit("x")), classes, "elevated", strict=True).first()
    assert tuple(none) == (1, "****", "****", "****", 2.5)
    assert tuple(std) == (1, "****", "a@b", "BC-1", 2.5)
    assert strict["new_col"] == "****" and strict["ssn_last4"] == "1234"


def test_match_questions_against_brute_force(spark):
    prods = [(1, "Payroll Dashboard", "Finance", ["Payroll", "HR"], "Payroll costs by department"),
             (2, "Budget Report", "Finance", ["Budget"], "Budget and expenditure by department"),
             (3, "Census Dataset", "Demographics", ["Census"], "Population by tract"),
             (4, "Fleet Trips", "Transportation", ["Fleet"], "Vehicle trips per day"),
             (5, "Payroll Archive", "HR", ["Payroll"], "Old payroll by year")]
    pdf = spark.createDataFrame(prods, "product_id long, display_name string, domain string, tags array<string>, description string")
    qs = spark.createDataFrame([(1, 0, "show payroll by department"), (2, 0, "vehicle trips"), (3, 0, "nothing here")],
                               "conv_id long, turn long, text string")
    got = {(r["conv_id"], r["rank"]): (r["product_id"], round(r["score"], 6))
           for r in S.match_questions(qs, pdf, 5, weighting="idf").collect()}

    import re
    def words(t):
        return {w for w in re.findall(r"[a-z0-9]+", t.lower()) if len(w) >= 2}
    pw = {p[0]: words(" ".join([p[1], p[2], " ".join(p[3]), p[4]])) for p in prods}
    n = len(prods)
    dfreq = {}
    for ws in pw.values():
        for w in ws:
            dfreq[w] = dfreq.get(w, 0) + 1
    idf = {w: max(0.0, math.log((n - c + 0.5) / (c + 0.5))) for w, c in dfreq.items()}
    want = {}
    for cid, text in [(1, "show payroll by department"), (2, "vehicle trips"), (3, "nothing here")]:
        qw = words(text)
        scores = [(round(sum(idf[w] for w in qw & pw[p]), 6), p) for p in pw]
        ranked = sorted([s for s in scores if s[0] > 0], key=lambda s: (-s[0], s[1]))[:5]
        for i, (sc, p) in enumerate(ranked, 1):
            want[(cid, i)] = (p, sc)
    assert got == want and want


def test_policy_rules_golden_cases(spark):
    cases = [("GET", "/api/portal/something-new", "admin"), ("POST", "/api/portal/admin/anything", "admin"),
             ("PUT", "/api/portal/requests/REQ-001/approve", "admin"), ("PUT", "/api/portal/requests/REQ-001/deny", "admin"),
             ("PUT", "/api/portal/requests/REQ-001/revoke", "admin"), ("POST", "/api/portal/admin/users", "admin"),
             ("PUT", "/api/portal/admin/users/abc", "admin"), ("PUT", "/api/portal/settings", "admin"),
             ("GET", "/api/portal/audit", "admin"), ("DELETE", "/api/portal/products/DP-001", "admin"),
             ("PUT", "/api/portal/products/DP-001", "admin"), ("POST", "/api/portal/admin/uc-run-grants", "admin"),
             ("GET", "/api/portal/products", "user"), ("POST", "/api/portal/products", "user"),
             ("GET", "/api/portal/products/DP-001/schema", "user"), ("GET", "/api/portal/products/DP-001/preview", "user"),
             ("POST", "/api/portal/requests", "user"), ("POST", "/api/portal/ask-catalog", "user"),
             ("GET", "/api/portal/library", "user"), ("GET", "/api/health", "public"), ("GET", "/api/portal/identity", "public"),
             ("GET", "/api/portal/config", "public"), ("PUT", "/api/portal/products/DP-001/publish", "admin"),
             ("GET", "/api/portal/products/pending", "admin")]
    df = spark.createDataFrame([(i, m, p, 0) for i, (m, p, _) in enumerate(cases)], "log_id long, method string, path string, user_id long")
    got = {r["log_id"]: r["level"] for r in G.policy_audit(df).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    from stewardlake.functions.rules import POLICY_RULES
    assert sum(1 for r in POLICY_RULES if r[2] == "public") == 3


def test_match_questions_count_weighting(spark):
    pdf = spark.createDataFrame([(1, "Payroll Dashboard", "Finance", ["HR"], "payroll by department"),
                                 (2, "Budget Report", "Finance", ["Budget"], "budget by department"),
                                 (3, "Fleet Trips", "Transport", ["Fleet"], "trips")],
                                "product_id long, display_name string, domain string, tags array<string>, description string")
    qs = spark.createDataFrame([(1, 0, "payroll by department please")], "conv_id long, turn long, text string")
    got = [(r["rank"], r["product_id"], r["shared_words"]) for r in S.match_questions(qs, pdf, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 3), (2, 2, 2)]


def test_intents_and_find_matches(spark):
    from stewardlake.functions.text import classify_intent

    texts = [(1, 0, "Anything waiting on me?"), (2, 0, "check my request"), (3, 0, "please nudge them"),
             (4, 0, "what data can I access"), (5, 0, "who owns payroll"), (6, 0, "find budget data"),
             (7, 0, "how do I request access"), (8, 0, "hello"), (9, 0, "zzz"), (10, 0, "Is there anything on fleet trips")]
    qs = spark.createDataFrame(texts, "conv_id long, turn long, text string")
    got = [r["i"] for r in qs.orderBy("conv_id").select(classify_intent("text").alias("i")).collect()]
    assert got == ["approvals", "status", "nudge", "access", "owner", "find", "how_to", "greeting", "fallback", "find"]

    norm = spark.createDataFrame([(1, "Budget Report 2024", "Finance"), (2, "Fleet Trips", "Transportation"),
                                  (3, "Payroll", "HR")], "product_id long, name string, category string")
    got = sorted((r["conv_id"], r["product_id"], r["n_matches"]) for r in S.find_matches(qs, norm).collect())
    # q6: keywords 'budget' (in the name of 1) and 'data' (nowhere).
    # q10: 'is there' and 'any' are stripped, leaving 'thing', 'fleet', 'trips'; the last two hit product 2.
    assert got == [(6, 1, 1), (10, 2, 1)]


def test_find_matches_against_brute_force(spark):
    import random

    rnd = random.Random(7)
    syll = ["bud", "get", "pay", "roll", "fle", "et", "tax", "hr", "data", "map", "geo", "trip", "sal", "es"]
    prods = []
    for i in range(300):
        name = " ".join("".join(rnd.choice(syll) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(1, 3)))
        prods.append((rnd.randint(0, 200_000), name.title(), rnd.choice(["Finance", "HR", "Geo", "Other"])))
    prods = list({p[0]: p for p in prods}.values())
    qs = [(i, 0, "find " + " ".join(rnd.choice(syll) + rnd.choice(syll) for _ in range(rnd.randint(1, 4))))
          for i in range(40)]
    norm = spark.createDataFrame(prods, "product_id long, name string, category string")
    qdf = spark.createDataFrame(qs, "conv_id long, turn long, text string")
    got = {}
    for r in S.find_matches(qdf, norm).collect():
        got.setdefault(r["conv_id"], [r["n_matches"], []])[1].append((r["rank"], r["product_id"]))

    want = {}
    for cid, _, text in qs:
        kws = {w for w in text.lower().replace("find", "").replace("any", "").split() if len(w) >= 3}
        hits = sorted((p[1], p[0]) for p in prods if any(k in p[1].lower() or k in p[2].lower() for k in kws))
        want[cid] = [len(hits), [(i + 1, pid) for i, (_, pid) in enumerate(hits[:4])] or [(None, None)]]
    for v in got.values():
        v[1].sort()
    assert got == want and len([v for v in want.values() if v[0]]) > 10


def test_notifications_lower_bound_option(spark):
    d = dt.datetime
    req = spark.createDataFrame([
        ("old", 1, 1, "Approved", d(2000, 1, 1), d(2000, 1, 2), d(2000, 4, 1)),     # long expired: listed by parity
        ("soon", 2, 1, "Approved", d(2001, 5, 1), d(2001, 5, 5), d(2001, 8, 10)),   # expires in 9 days
        ("late", 3, 1, "Approved", d(2001, 6, 1), d(2001, 6, 5), d(2001, 12, 1))],  # not within 14 days
        REQ_SCHEMA)
    prods = spark.createDataFrame([(1, "DP-001", "a"), (2, "DP-002", "b"), (3, "DP-003", "c")],
                                  "product_id long, product_ref string, display_name string")
    as_of = ts_ntz("2001-08-01 00:00:00")
    parity = {r["request_id"] for r in A.notifications(req, prods, as_of).filter("kind = 'Expiring'").collect()}
    future = {r["request_id"] for r in A.notifications(req, prods, as_of, only_future=True).filter("kind = 'Expiring'").collect()}
    assert parity == {"old", "soon"} and future == {"soon"}
