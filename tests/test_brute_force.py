"""Randomized comparisons of jobs against direct Python versions of the rules."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stewardlake.operators import access as A
from stewardlake.operators import demand as D
from stewardlake.sources.fixtures import ts_ntz

REQ_SCHEMA = ("request_id string, product_id long, requester_id long, status string, requested_at timestamp_ntz, "
              "resolved_at timestamp_ntz, expires_at timestamp_ntz")
AS_OF = dt.datetime(2001, 8, 1)


def test_access_state_matches_first_match_rules(spark):
    rnd = random.Random(11)
    base = dt.datetime(2000, 1, 1)
    used = set()
    rows = []
    for i in range(3000):
        while True:
            minute = rnd.randint(0, 900_000)
            if minute not in used:
                used.add(minute)
                break
        req = base + dt.timedelta(minutes=minute)
        status = rnd.choice(["Approved", "Pending", "Denied", "Revoked"])
        res = None if status == "Pending" else req + dt.timedelta(days=rnd.randint(0, 30))
        exp = None
        if status == "Approved":
            exp = rnd.choice([None, res + dt.timedelta(days=rnd.choice([10, 90, 400, 700]))])
        rows.append((f"r{i:05d}", rnd.randint(1, 25), rnd.randint(1, 40), status, req, res, exp))
    admins = {u for u in range(1, 41) if u % 4 == 0}
    users = spark.createDataFrame([(u, "admin" if u in admins else "analyst") for u in range(1, 41)],
                                  "user_id long, role string")
    got = {(r["requester_id"], r["product_id"]): (r["state"], r["request_id"])
           for r in A.access_state(spark.createDataFrame(rows, REQ_SCHEMA), users, ts_ntz("2001-08-01 00:00:00")).collect()}

    want = {}
    by_key = {}
    for r in rows:
        by_key.setdefault((r[2], r[1]), []).append(r)
    for key, mine in by_key.items():
        mine = sorted(mine, key=lambda r: r[5] or r[4], reverse=True)  # newest first
        granted = next((r for r in mine if r[3] == "Approved" and not (r[6] and r[6] < AS_OF)), None)
        revoked = next((r for r in mine if r[3] == "Revoked"), None)
        pending = next((r for r in mine if r[3] == "Pending"), None)
        if granted:
            want[key] = ("granted", granted[0])
        elif revoked:
            want[key] = ("revoked", revoked[0])
        elif pending:
            want[key] = ("pending", pending[0])
        else:
            want[key] = ("admin" if key[0] in admins else "none", None)
    assert got == want
    assert {v[0] for v in want.values()} == {"granted", "revoked", "pending", "admin", "none"}


def test_vote_toggles_match_sequential_replay(spark):
    rnd = random.Random(5)
    votes = {(rnd.randint(1, 10), rnd.randint(1, 30)) for _ in range(120)}
    toggles = [(rnd.randint(1, 10), rnd.randint(1, 30)) for _ in range(400)]
    state = set(votes)
    for t in toggles:  # the reference applies one toggle at a time
        state.symmetric_difference_update({t})
    out = D.toggle_votes(spark.createDataFrame(sorted(votes), "request_id long, voter_id long"),
                         spark.createDataFrame(toggles, "request_id long, voter_id long"),
                         spark.createDataFrame([(i,) for i in range(1, 11)], "request_id long"))
    assert {tuple(r) for r in out["feature_request_votes"].collect()} == state
    counts = {r["request_id"]: r["upvotes"] for r in out["upvotes"].collect()}
    assert counts == {i: sum(1 for v in state if v[0] == i) for i in range(1, 11)}
    assert out["upvotes"].filter(F.col("upvotes") < 0).count() == 0


def test_notifications_match_per_user_lists(spark):
    rnd = random.Random(3)
    base = dt.datetime(2001, 6, 1)
    rows = []
    for i in range(2500):
        req = base + dt.timedelta(minutes=rnd.randint(0, 80_000))
        status = rnd.choice(["Approved", "Pending", "Denied", "Revoked"])
        res = None if status == "Pending" else req + dt.timedelta(minutes=rnd.randint(0, 10_000))
        exp = res + dt.timedelta(minutes=rnd.randint(0, 120_000)) if status == "Approved" else None
        rows.append((f"r{i:05d}", rnd.randint(1, 5), rnd.randint(1, 30), status, req, res, exp))
    prods = spark.createDataFrame([(p, f"DP-{p:03d}", f"P{p}") for p in range(1, 6)],
                                  "product_id long, product_ref string, display_name string")
    got = {(r["requester_id"], r["kind"], r["rank"]): r["request_id"]
           for r in A.notifications(spark.createDataFrame(rows, REQ_SCHEMA), prods, ts_ntz("2001-08-01 00:00:00")).collect()}
    want = {}
    for u in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == u]
        exp = sorted((r for r in mine if r[3] == "Approved" and r[6] < AS_OF + dt.timedelta(days=14)),
                     key=lambda r: (r[6], r[0]))[:5]
        rec = sorted((r for r in mine if r[3] in ("Approved", "Denied", "Revoked") and r[5] > AS_OF - dt.timedelta(days=7)),
                     key=lambda r: (-r[5].timestamp(), r[0]))[:10]
        for i, r in enumerate(exp, 1):
            want[(u, "Expiring", i)] = r[0]
        for i, r in enumerate(rec, 1):
            want[(u, r[3], i)] = r[0]
    assert got == want and len(want) > 100


def test_all_words_search_matches_page_filter(spark):
    from stewardlake.operators import catalog as C

    rnd = random.Random(9)
    vocab = ["budget", "payroll", "fleet", "tax", "census", "report", "daily", "hr", "geo", "x"]
    rows = []
    for i in range(400):
        rows.append((i, " ".join(rnd.sample(vocab, 2)).title(), rnd.choice(vocab + [None]), rnd.choice(vocab),
                     " ".join(rnd.sample(vocab, 3)), [rnd.choice(vocab).upper() for _ in range(rnd.randint(0, 2))]))
    norm = spark.createDataFrame(rows, "product_id long, name string, description string, category string, "
                                 "source string, tags array<string>") \
        .withColumn("description", F.coalesce("description", F.lit("")))
    for q in ["budget", "Tax  Report", "hr geo x", "nothing"]:
        got = {r["product_id"] for r in C.catalog_all_words(norm, q).collect()}
        words = q.lower().split()
        want = {r[0] for r in rows if all(
            w in r[1].lower() or w in (r[2] or "").lower() or w in r[3].lower() or w in r[4].lower()
            or any(w in t.lower() for t in r[5]) for w in words)}
        assert got == want, q


def test_display_names_match_ascii_rules(spark):
    import re

    from stewardlake.functions.text import display_name, name_from_email

    rnd = random.Random(17)
    alphabet = ["a", "b", "g", "o", "l", "d", "x", "_", " ", "é", "1", "-", "G", "O", "L", "D", "."]
    names = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    names += ["sales_gold_orders", "gold_gold", "goldé_x", "x_golden_gold", "GOLD"]

    def py_display(s):
        s = s.replace("_", " ")
        s = re.sub(r"\bgold\b", "", s, count=1, flags=re.I | re.A).strip(" ")
        return re.sub(r"\b\w", lambda m: m.group(0).upper(), s, flags=re.A)

    def py_name(email):
        local = email.split("@")[0]
        return re.sub(r"\b\w", lambda m: m.group(0).upper(), re.sub(r"[._]", " ", local), flags=re.A)

    df = spark.createDataFrame([(i, n, n + "@x.org") for i, n in enumerate(names)], "i long, n string, e string")
    got = {r["i"]: (r["d"], r["m"]) for r in df.select("i", display_name("n").alias("d"), name_from_email("e").alias("m")).collect()}
    for i, n in enumerate(names):
        assert got[i] == (py_display(n), py_name(n + "@x.org")), n


def test_question_rules_match_on_the_conversation_log(spark):
    """is_question / classify_intent over every conversation turn (sf0.01)
    against Python regexes with the reference's ASCII word semantics."""
    import re

    from stewardlake.functions import rules
    from stewardlake.functions.text import classify_intent, is_question

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = {(r["conv_id"], r["turn"]): (r["q"], r["i"]) for r in conv.select(
        "conv_id", "turn", is_question("text").alias("q"), classify_intent("text").alias("i")).collect()}
    start = re.compile(rules.QUESTION_START, re.I | re.A)
    phrase = re.compile(rules.QUESTION_PHRASE, re.I | re.A)
    intents = [(n, re.compile(p, re.A)) for n, p in rules.INTENT_RULES]
    ws = " \t\n\x0b\f\r"
    n_checked = 0
    for r in conv.select("conv_id", "turn", "text").collect():
        t = r["text"] or ""
        tt = t.strip(ws)
        q = len([w for w in re.split(f"[{ws}]+", tt) if w]) >= 3 and bool(start.search(tt) or phrase.search(t))
        low = t.lower()
        intent = next((n for n, p in intents if p.search(low)), rules.INTENT_DEFAULT)
        assert got[(r["conv_id"], r["turn"])] == (q, intent), t[:80]
        n_checked += 1
    assert n_checked > 400


def test_strip_markdown_matches_reference_regexes_on_documents(spark):
    """strip_markdown over every document (sf0.01, whole texts) against the
    reference's regexes run with Python's engine ('.' stops at line breaks)."""
    import re

    from stewardlake.functions.text import strip_markdown

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["t"] for r in docs.select("doc_id", strip_markdown("text").alias("t")).collect()}
    dot = "[^\n\r  ]"

    def ref(t):
        t = re.sub(rf"\*\*({dot}+?)\*\*", r"\1", t)
        t = re.sub(rf"\*({dot}+?)\*", r"\1", t)
        t = re.sub(r"^#+\s+", "", t, flags=re.M)
        t = re.sub(r"^[*\-]\s+", "• ", t, flags=re.M)
        return t.strip()

    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    assert sum(1 for _, t in rows if "*" in t or "#" in t) > 10
    assert all(got[k] == ref(t) for k, t in rows)


def test_policy_levels_over_the_access_log(spark):
    """Every logged call of the sf0.01 access log against a first-match scan of
    the rule table with Python regexes."""
    import re

    from stewardlake.functions import rules
    from stewardlake.operators import governance as G
    from stewardlake.sources.fixtures import tables

    log = tables(spark, "/root/testdata/sf0.01").access_log
    got = {r["log_id"]: (r["level"], r["rule_index"]) for r in G.policy_audit(log).collect()}
    compiled = [(m, re.compile(p), lvl) for m, p, lvl in rules.POLICY_RULES]

    def level(method, path):
        for i, (m, p, lvl) in enumerate(compiled):
            if (m == "*" or m == method) and p.search(path):
                return lvl, i
        return rules.POLICY_DEFAULT_LEVEL, None

    rows = log.select("log_id", "method", "path").collect()
    assert all(got[r["log_id"]] == level(r["method"], r["path"]) for r in rows)
    assert {v[0] for v in got.values()} == {"public", "user", "admin"}


def test_group_roles_match_best_of_groups(spark):
    from stewardlake.operators import governance as G

    rnd = random.Random(21)
    groups = [(f"G{i}", rnd.choice(["admin", "steward", "analyst", "Admin", "viewer"])) for i in range(12)]
    users = [(u, rnd.choice([g[0] for g in groups] + ["NONE"])) for u in range(300)]
    got = {r["user_id"]: (r["group_name"], r["group_role"]) for r in G.user_group_role(
        spark.createDataFrame(users, "user_id long, department string"),
        spark.createDataFrame(groups, "group_name string, role string")).collect()}
    prio = lambda role: 0 if role.lower() == "admin" else 1 if role.lower() == "steward" else 2
    want = {}
    for u, dept in users:
        cands = sorted((prio(r), g, r) for g, r in groups if g == dept)
        if cands:
            want[u] = (cands[0][1], cands[0][2])
    assert got == want
