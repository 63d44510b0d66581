"""The bounded top-k search against comparing every word set with every product."""

import random

import pytest

from stewardlake.operators import search as S
from stewardlake.operators import topk

PRODUCT = "product_id long, display_name string, domain string, tags array<string>, description string"


def _catalog(n, seed=1, ids=lambda rnd, i: i):
    """Products with one word in a third of them, one in a fifth, and rarer ones."""
    rnd = random.Random(seed)
    rare = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        ws = rnd.sample(rare, rnd.randint(0, 3))
        ws += ["sales"] * (rnd.random() < 1 / 3) + ["report"] * (rnd.random() < 1 / 5) + ["daily"] * (rnd.random() < 1 / 10)
        out.append((ids(rnd, i), " ".join(ws), None, [], None))
    return list({p[0]: p for p in out}.values())


def _ask(seed, n):
    rnd = random.Random(seed)
    words = ["sales", "report", "daily", *(f"w{i}" for i in range(60)), "unknown"]
    return [(i, 0, " ".join(rnd.choices(words[:4] if i % 3 == 0 else words, k=rnd.randint(0, 6)))) for i in range(n)]


@pytest.mark.parametrize("weighting", ["count", "idf"])
@pytest.mark.parametrize("ids", [lambda rnd, i: i, lambda rnd, i: rnd.choice([-1, 1]) * rnd.randint(0, 10**12)])
def test_search_equals_pairing_everything(spark, weighting, ids):
    products = spark.createDataFrame(_catalog(1500, ids=ids), PRODUCT)
    questions = spark.createDataFrame(_ask(2, 60), "conv_id long, turn long, text string")
    want = S.match_questions(questions, products, 5, weighting, direct_pairs=10**9)  # compared with plain Python elsewhere
    got = S.match_questions(questions, products, 5, weighting, direct_pairs=0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.schema == want.schema


def test_frequent_words_pair_few_products(spark):
    """Sets of words that a third and a fifth of 20,000 products have: at most two blocks each, 25 k pairs a set."""
    rows = _catalog(20_000, seed=5)
    products = spark.createDataFrame(rows, PRODUCT)
    sets = [(f"s{i}", w, 1.0) for i, ws in enumerate([["sales"], ["report"], ["sales", "report"], ["daily", "sales"], ["daily"]]) for w in ws]
    asked = spark.createDataFrame(sets, "set_id string, word string, w double")
    formed = []
    got = topk.top_products(asked, topk.Postings(S.product_words(products)), 5, formed)
    assert got.count() == 25 and sum(formed) <= 25 * 5 * 5
    having = {w: {p[0] for p in rows if w in p[1].split()} for w in ("sales", "report", "daily")}
    both = sorted(having["sales"] & having["report"])[:5]
    assert [r["product_id"] for r in got.where("set_id = 's2'").orderBy("rank").collect()] == both
    assert sum(len(v) for v in having.values()) > 10_000


def test_search_of_nothing(spark):
    products = spark.createDataFrame([], PRODUCT)
    questions = spark.createDataFrame([(1, 0, "sales"), (2, 0, None), (3, 0, "")], "conv_id long, turn long, text string")
    assert S.match_questions(questions, products, 5, direct_pairs=-1).count() == 0
    some = spark.createDataFrame(_catalog(10), PRODUCT)
    assert S.match_questions(questions.limit(0), some, 5, direct_pairs=-1).count() == 0


def test_registered_query_in_rounds(spark, monkeypatch):
    import __spark_entry__ as E
    from tools.oracle_check import canon, duck

    sf = "/root/testdata/sf0.001"
    whole = S.match_questions
    monkeypatch.setattr(S, "match_questions", lambda *a: whole(*a, direct_pairs=0))
    df = E.queries()["match_questions"](spark, sf)
    cur = duck(sf).execute(E.oracle_sql()["match_questions"])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())
