"""Quality classifier against a plain interpolated modified Kneser-Ney model."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stewardlake.llm import quality

N = quality.ORDER


def padded(text):
    return quality.START * (N - 1) + re.sub(r"\s+", " ", text).strip() + quality.END


class Plain:
    """Probabilities straight from the definition, by recursion."""

    def __init__(self, texts):
        self.c = {N: Counter(p[i:i + N] for t in texts for p in [padded(t)] for i in range(len(p) - N + 1))}
        for k in range(N - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.follow = {}, {}
        for k in range(1, N + 1):
            n = Counter(self.c[k].values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
            d = [0.5, 0.75, 0.9] if y is None else [
                1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
            self.d[k] = d if y is None else [min(max(x, 0.01), i + 0.99) for i, x in enumerate(d)]
            self.follow[k] = defaultdict(list)
            for g, c in self.c[k].items():
                self.follow[k][g[:-1]].append(c)
        self.symbols = len(self.c[1]) + 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / self.symbols
        seen = self.follow[k].get(gram[:-1])
        below = self.p(gram[1:])
        if not seen:
            return below
        d = self.d[k]
        cut = lambda c: d[min(c, 3) - 1]
        own = self.c[k].get(gram, 0)
        return ((own - cut(own)) if own else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * below

    def perplexity(self, text):
        p = padded(text)
        logs = [math.log(self.p(p[i:i + N])) for i in range(len(p) - N + 1)]
        return math.exp(-sum(logs) / len(logs))


def test_perplexity_equals_the_definition(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(1000, None, "en"), (1001, " \n", None), (1002, "漢字 ü \x02", "xx"), (1003, "the the", None)],
                                "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(odd)
    trusted = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    fold = {r["doc_id"]: r["f"] for r in rows.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % quality.HELD_OUT).alias("f")).collect()}
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    plain = Plain([t for i, t in texts.items() if i in trusted and fold[i]])
    got = {r["doc_id"]: r for r in quality.classify(rows, labels).collect()}
    assert got.keys() == texts.keys()
    for i in sorted(texts)[::7] + [1002, 1003]:
        text = texts[i].replace("\x02", " ")
        assert got[i]["perplexity"] == pytest.approx(plain.perplexity(text), rel=1e-9)
    for i in (1000, 1001):
        assert got[i]["perplexity"] is None and not got[i]["high_quality"]
    assert all(r["high_quality"] == (r["perplexity"] <= r["threshold"]) for r in got.values() if r["perplexity"])
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    kept = [r["high_quality"] for i, r in got.items() if i in trusted]
    assert sum(kept) >= 0.9 * len(kept)
    assert len(bad)


def test_low_quality_is_found_and_blocks_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert sum(not one[i]["high_quality"] for i in bad) >= 0.7 * len(bad)
    assert sum(one[i]["high_quality"] for i in good) >= 0.97 * len(good)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 50_000)
    monkeypatch.setattr(quality, "PACK", 20_000)
    monkeypatch.setattr(quality, "PART", 5000)
    many = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert all(many[i]["perplexity"] == pytest.approx(one[i]["perplexity"], rel=1e-9) for i in one)


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(9, 1), (9, 1), (16, 1), (29, 0)], "doc_id long, quality int")
    none = labels.where("quality > 1")
    assert quality.classify(edge, labels).count() == 41
    assert quality.classify(nothing, labels).count() == 0
    got = quality.classify(edge, none).collect()
    assert len(got) == 41 and all(r["perplexity"] is None and r["threshold"] is None for r in got)
    assert all(r["high_quality"] == (r["doc_id"] not in (0, 1, 2, 20, 21, 22)) for r in got)


def test_equal_rows_are_each_scored(spark):
    rows = [(1, "en", "the cat sat on the mat")] * 30 + [(1, "en", "the dog ran")] * 2 + [(1, None, "the dog ran"), (None, "en", "the dog ran"), (2, "en", " ")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert sorted((r["doc_id"] or 0, r["lang"] or "") for r in got) == sorted((i or 0, c or "") for i, c, _ in rows)
    plain = Plain([t for i, _, t in rows if i == 1])
    for text, n in (("the cat sat on the mat", 30), ("the dog ran", 4)):
        want = pytest.approx(plain.perplexity(text), rel=1e-9)
        assert sum(r["perplexity"] is not None and r["perplexity"] == want for r in got) == n
