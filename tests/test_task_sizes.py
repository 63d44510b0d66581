"""Work in tasks of bounded size, and no broadcast on an estimate from small files."""

import random
import uuid

from pyspark.sql import functions as F

from stewardlake.operators import access as A
from stewardlake.operators import changes as CH
from stewardlake.operators import common, topk
from stewardlake.operators import search as S
from stewardlake.operators import textindex as X
from stewardlake.session import checkpoint_subdir
from stewardlake.sources.bucketed import BucketedTable
from stewardlake.streaming import audit as T


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _norm(spark, n=120):
    rnd = random.Random(5)
    names = ["red", "straightforward", "ring", "wheelbarrow", "hot\tbolt"]
    return [(i, f"{rnd.choice(names)} {rnd.choice(names)} {i}".title(), rnd.choice(["LARGE", "Other", None])) for i in range(100, 100 + n)]


def test_keyword_index_is_not_broadcast(spark):
    norm = spark.createDataFrame(_norm(spark), "product_id long, name string, category string")
    asked = spark.createDataFrame([("red",), ("straightforward",)], "kw string")
    assert "Broadcast" not in _plan(S.keyword_matches(asked, norm))


def test_find_matches_counts_hot_and_rare_keywords(spark):
    """Hot words, a number, long words and their inner pieces, and one that nothing has; products and questions repeat."""
    rows = _norm(spark)
    rows += rows[:7]
    norm = spark.createDataFrame(rows, "product_id long, name string, category string")
    texts = ["find red 123", "find ring large wheelbarrow 20", "find straightforward", "find eelbarr 110 11", "find traightforwards",
             "find raightforwar 150", "find zzz", "find 199 200 201 bolt", "find other"]
    qs = spark.createDataFrame([(i % 8, 0, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")
    kws = {}
    for i, t in enumerate(texts):
        kws.setdefault(i % 8, set()).update(w for w in t.replace("find", "").split() if len(w) >= 3)
    want = {c: sorted({(n, p) for p, n, g in rows if any(k in n.lower() or k in (g or "").lower() for k in ws)}) for c, ws in kws.items()}
    for hot in (0, 3, 1000):
        got = {}
        for r in S.find_matches(qs, norm, hot=hot).collect():
            got.setdefault(r["conv_id"], (r["n_matches"], set()))[1].add((r["rank"], r["name"], r["product_id"]))
        assert got == {c: (len(w), {(i, *x) for i, x in enumerate(w[:4], 1)} or {(None, None, None)}) for c, w in want.items()}


def test_words_of_products_are_made_in_small_tasks(spark, monkeypatch):
    """One file of products is many tasks, whole blocks in each; pairs too are split, a frequent word among them."""
    rows = [(i, f"ring {i % 7}", "LARGE", ["a"], None) for i in range(1000)]
    products = spark.createDataFrame(rows, "product_id long, display_name string, domain string, tags array<string>, description string").coalesce(1)
    qs = spark.createDataFrame([(i, 0, f"a large ring {i % 9}") for i in range(20)], "conv_id long, turn long, text string")
    want = sorted(map(tuple, S.match_questions(qs, products).collect()))
    monkeypatch.setattr(common, "ROWS_IN_TASK", 100)
    monkeypatch.setattr(S, "PAIRS_IN_TASK", 1500)
    seen = []
    make = S.product_words
    monkeypatch.setattr(S, "product_words", lambda p: seen.append(p) or make(p))
    got = S.match_questions(qs, products)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 100
    blocks = seen[0].select(topk.node("product_id", 0).alias("block"), F.spark_partition_id().alias("task")).distinct().groupBy("block").agg(
        F.count(F.lit(1)).alias("n"))
    assert seen[0].rdd.getNumPartitions() == 10 and {r["n"] for r in blocks.collect()} == {1}
    assert sorted(map(tuple, S.match_questions(qs, products, direct_pairs=0).collect())) == want


def test_index_is_built_in_small_tasks(spark, monkeypatch):
    """One file of products is many tasks of whole blocks, and n-grams are not shuffled after they are made."""
    rows = [(i, f"DP-{i}", f"ring {i}", "LARGE", "Brand#1", ["a"]) for i in range(1000)]
    products = spark.createDataFrame(rows, "product_id long, product_ref string, display_name string, domain string, source_system string, tags array<string>").coalesce(1).withColumn("description", F.lit(None).cast("string"))
    want = sorted(map(tuple, X.postings(products).collect()))
    monkeypatch.setattr(common, "ROWS_IN_TASK", 100)
    got = X.postings(products)
    assert _plan(got).count("Exchange") == 1 and got.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, got.collect())) == want


def test_many_searches_of_one_text_are_checked_once(spark):
    """Searches and products that repeat give every pair; the check runs per text, so a word that many ask is not paired with all."""
    rows = [(i, f"DP-{i}", f"ring {i}", None, None, ["a"]) for i in range(200)]
    schema = "product_id long, product_ref string, display_name string, domain string, source_system string, tags array<string>"
    products = spark.createDataFrame(rows + rows[:3], schema).withColumn("description", F.lit(None).cast("string"))
    index = X.StoredIndex(spark, checkpoint_subdir(spark, f"t-index-{uuid.uuid4().hex[:8]}")).build(products)
    asked = [(i * 100_000, "RING") for i in range(30)] + [(0, "RING"), (7, "ing 15"), (8, "qring 1"), (9, None)]
    got = X.search_admin(index, spark.createDataFrame(asked, "query_id long, q string"), products)
    names = [(r[0], r[2]) for r in rows + rows[:3]]
    want = sorted((i, p) for i, q in asked if q for p, n in names if q.lower() in n)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 6000
    assert "Generate explode(query_ids" in _plan(got)


def test_pairs_are_handed_on_one_at_a_time(spark, monkeypatch):
    """A text that all ask of all products: the products of a list are not expanded by the generated code that expands the
    searches, which would keep all their pairs at once."""
    rows = [(i, f"DP-{i}", f"ring {i}", None, None, ["a"]) for i in range(300)]
    schema = "product_id long, product_ref string, display_name string, domain string, source_system string, tags array<string>"
    products = spark.createDataFrame(rows, schema).withColumn("description", F.lit(None).cast("string"))
    index = X.StoredIndex(spark, checkpoint_subdir(spark, f"t-index-{uuid.uuid4().hex[:8]}")).build(products)
    monkeypatch.setattr(X, "LISTED", 20, raising=False)
    asked = spark.range(1000).selectExpr("id AS query_id", "'ring' AS q")
    got = X.search_ilike(index, asked, products)
    plan = _plan(got)
    assert "Generate explode(filter(product_ids" in plan and "Generate explode(product_ids" not in plan
    assert got.count() == 300_000 and got.distinct().count() == 300_000


def _join_rows(df):
    """The largest number of rows that a join made."""
    def rows(p):
        own = [p.metrics().get("numOutputRows").get().value()] if "Join" in p.nodeName() else []
        return own + [r for i in range(p.children().size()) for r in rows(p.children().apply(i))]

    df.collect()
    return max(rows(df._jdf.queryExecution().executedPlan()), default=0)


def test_words_share_the_blocks_of_their_ngrams(spark, monkeypatch):
    """Many numbers with the same digits, asked with their prefix: blocks are met for each different start, not for each word."""
    names = [f"dp-{i}" for i in range(10_000, 19_000)]
    products = spark.range(9_000).selectExpr(
        "id AS product_id", "concat('DP-', 10000 + id) AS product_ref", "CAST(NULL AS string) AS display_name", "CAST(NULL AS string) AS domain",
        "CAST(NULL AS string) AS source_system", "array('a') AS tags", "CAST(NULL AS string) AS description")
    index = X.StoredIndex(spark, checkpoint_subdir(spark, f"t-index-{uuid.uuid4().hex[:8]}")).build(products)
    made = []
    fixed = X.fixed
    monkeypatch.setattr(X, "fixed", lambda df: made.append(_join_rows(df)) or fixed(df))
    asked = spark.createDataFrame([(i, [n]) for i, n in enumerate(names) if i % 9 == 1], "query_id long, words array<string>")
    got = _with_conf(spark, {"spark.sql.adaptive.enabled": "false"}, lambda: X.candidates(index, asked, ["ref"]).collect())
    grams = [{n[k:k + 3] for k in range(len(n) - 2)} for n in names]
    found = set(map(tuple, got))
    assert {(i, i) for i in range(9_000) if i % 9 == 1} <= found and all(grams[i] <= grams[j] for i, j in found) and len(found) == len(got)
    assert max(made) < 30_000, made


def test_a_search_with_an_unknown_word_reads_no_bitmaps(spark, monkeypatch):
    rows = [(i, f"DP-{i}", f"sales report {i}", None, None, ["a"]) for i in range(300)]
    schema = "product_id long, product_ref string, display_name string, domain string, source_system string, tags array<string>"
    products = spark.createDataFrame(rows, schema).withColumn("description", F.lit(None).cast("string"))
    index = X.StoredIndex(spark, checkpoint_subdir(spark, f"t-index-{uuid.uuid4().hex[:8]}")).build(products)
    seen = []
    fixed = X.fixed
    monkeypatch.setattr(X, "fixed", lambda df: seen.append(fixed(df)) or seen[-1])
    asked = spark.createDataFrame([(1, ["report", "zzz"]), (2, ["123"]), (3, ["sales", "12", "s"])], "query_id long, words array<string>")
    got = X.candidates(index, asked, ["name"]).collect()
    want = [(2, 123), *[(3, i) for i in range(300) if "12" in str(i)]]
    assert sorted(map(tuple, got)) == want
    held = [df for df in seen if {"word", "block", "bits"} <= set(df.columns)]
    assert {r["word"] for df in held for r in df.select("word").distinct().collect()} == {"123", "sales", "12", "s"}


def _with_conf(spark, conf, run):
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_decisions_of_one_approver_are_many_tasks(spark):
    decisions = spark.createDataFrame([(f"r{i}", "one@x") for i in range(500)] + [("n", None), ("u", "nobody@x")], "request_id string, approver_email string")
    users = spark.createDataFrame([(7, "one@x"), (3, "one@x"), (1, None)], "user_id long, email string")

    def run():
        out = CH._approver_ids(decisions, users)
        return out.withColumn("task", F.spark_partition_id()).collect()

    rows = _with_conf(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}, run)
    assert len(rows) == 502 and {(r["approver_email"], r["_approver_id"]) for r in rows} == {("one@x", 3), (None, None), ("nobody@x", None)}
    assert len({r["task"] for r in rows if r["approver_email"] == "one@x"}) > 1


def test_a_part_is_written_by_tasks_of_bounded_size(spark):
    name = f"t_sizes_{uuid.uuid4().hex[:8]}"
    table = BucketedTable(spark, name, checkpoint_subdir(spark, name), ["requester_id"], buckets=1, parts=1)
    df = spark.range(20_000).select(F.col("id").alias("requester_id"), F.col("id").alias("n"))
    try:
        _with_conf(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}, lambda: table.create(df))
        assert len(table.read().inputFiles()) > 1
        _with_conf(spark, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}, lambda: table.change(
            spark.createDataFrame([(5,)], "requester_id long"), ["requester_id"], lambda old: old.withColumn("n", F.col("n") + 1)))
        assert len(table.read().inputFiles()) > 1
        assert table.read().agg(F.sum("n"), F.count(F.lit(1)), F.count_distinct("requester_id")).first()[:] == (200_010_000, 20_000, 20_000)
    finally:
        table.drop()


def test_a_day_lands_as_one_file(spark):
    landing, out, ckpt = T.new_run_dirs(spark, "t-sizes")
    ev = spark.range(400, numPartitions=8).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast(id % 3 AS int))").alias("ts"))
    pattern = T.land_by_day(ev, landing)
    landed = spark.read.option("basePath", landing).parquet(pattern)
    assert landed.count() == 400 and len(landed.inputFiles()) == 3
    T.discard(spark, landing, out, ckpt)


def test_wide_rows_of_requests_are_shuffled_without_product_columns(spark):
    """Users' columns are the narrower ones, so they are joined before the last shuffle of the requests."""
    req = spark.createDataFrame([("r", 1, 2, "Pending", "why", None, None, None)], "request_id string, product_id long, requester_id long, "
                                "status string, business_reason string, requested_at timestamp_ntz, resolved_at timestamp_ntz, expires_at timestamp_ntz")
    products = spark.createDataFrame([(1, "DP-001", "a", "b", "c", "d")], "product_id long, product_ref string, display_name string, domain string, type string, uc_full_name string")
    users = spark.createDataFrame([(2, "e", "n", "t")], "user_id long, email string, display_name string, department string")

    def run():
        out = A.requests_detail(req, products, users)
        return _plan(out), [r["requester_team"] for r in out.collect()]

    plan, rows = _with_conf(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}, run)
    assert rows == ["t"] and plan.index("hashpartitioning(product_id") < plan.index("hashpartitioning(requester_id")
