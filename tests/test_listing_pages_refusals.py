"""Metadata diffs from hashes, pages by key ranges, refused rows."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from stewardlake.operators import changes as CH
from stewardlake.operators import refusals as R
from stewardlake.plans.params import requests_as_of
from stewardlake.session import checkpoint_subdir
from stewardlake.sources import listing as L
from stewardlake.sources.fixtures import tables
from stewardlake.sources.pages import PageStore

COLS = "catalog_name string, schema_name string, table_name string, column_name string, data_type string, tags string"


@pytest.fixture()
def base(spark):
    return checkpoint_subdir(spark, f"test_{uuid.uuid4().hex[:12]}")


def _random_listing(rnd):
    rows = {}
    for _ in range(300):
        key = (rnd.choice(["a", "b", None]), rnd.choice(["s", "t", ""]), rnd.choice(["x", "y", "z", None]), f"c{rnd.randrange(12)}")
        rows[key] = (rnd.choice(["int", "string", None]), rnd.choice([None, "[p]"]))
    return rows


def _plain_changes(old, new):
    out = set()
    for k in old.keys() | new.keys():
        o, n = old.get(k), new.get(k)
        if o is None:
            out.add((*k, "added", None, n[0], None, n[1]))
        elif n is None:
            out.add((*k, "dropped", o[0], None, o[1], None))
        else:
            out |= {(*k, w, o[0], n[0], o[1], n[1]) for w, i in (("retyped", 0), ("retagged", 1)) if o[i] != n[i]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_a_full_outer_join(spark, base, seed):
    rnd = random.Random(seed)
    old = _random_listing(rnd)
    new = dict(old)
    for k in rnd.sample(sorted(old, key=str), 20):
        if rnd.random() < 0.4:
            del new[k]
        else:
            new[k] = (rnd.choice(["int", "date", None]), rnd.choice([None, "[q]"]))
    new[("a", "new", "t", "c")] = ("int", None)

    def stored(rows, name):
        data = [(*k, *v) for k, v in rows.items()]
        return L.Listing(spark, f"{base}/{name}", parts=8).write(spark.createDataFrame(data + data[:5], COLS))  # some listed twice

    got = {tuple(r) for r in L.changes(stored(old, "old"), stored(new, "new")).select(*L.CHANGED).collect()}
    assert got == _plain_changes(old, new)


def test_unchanged_schemas_are_not_opened(spark, base):
    names = [(f"cat{i}", f"schema{j}", "t", c, "int", None) for i in range(4) for j in range(4) for c in ("u", "v")]
    old = L.Listing(spark, f"{base}/old").write(spark.createDataFrame(names, COLS))
    new = L.Listing(spark, f"{base}/new").write(
        spark.createDataFrame([(*r[:4], "date" if r[:4] == ("cat1", "schema2", "t", "u") else r[4], r[5]) for r in names], COLS))
    opened = [r["part"] for r in L.changed_schemas(old, new).collect()]
    assert len(opened) == 1
    for side in ("old", "new"):
        for part in os.listdir(f"{base.removeprefix('file:')}/{side}/columns"):
            if part.startswith("part=") and part != f"part={opened[0]}":
                folder = f"{base.removeprefix('file:')}/{side}/columns/{part}"
                for f in os.listdir(folder):
                    if f.endswith(".parquet"):
                        with open(f"{folder}/{f}", "wb") as out:
                            out.write(b"not a parquet file, reading it fails")
                        crc = f"{folder}/.{f}.crc"
                        if os.path.exists(crc):
                            os.remove(crc)
    assert [(r["column_name"], r["change"], r["old_type"], r["new_type"]) for r in L.changes(old, new).collect()] == [
        ("u", "retyped", "int", "date")]


def test_empty_listings(spark, base):
    some = spark.createDataFrame([("a", "b", "t", "c", "int", None)], COLS)
    empty = L.Listing(spark, f"{base}/e").write(some.limit(0))
    full = L.Listing(spark, f"{base}/f").write(some)
    assert [r["change"] for r in L.changes(empty, full).collect()] == ["added"]
    assert [r["change"] for r in L.changes(full, empty).collect()] == ["dropped"]
    assert L.changes(empty, empty).count() == 0
    with pytest.raises(ValueError):
        L.changes(empty, L.Listing(spark, f"{base}/f", parts=2))


# ---- pages -----------------------------------------------------------------------------------
def test_every_page_equals_the_sorted_list(spark, base):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, "", "a", "b b", "Zed", "é"]), i, f"text {i}") for i in range(100)]
    store = PageStore(spark, base).write(spark.createDataFrame(rows, "name string, product_id long, page_text string"),
                                         ["name", "product_id"], rows_in_part=17)
    want = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    assert store.total_pages() == 17
    for page in range(1, 18):
        got = store.read(page).collect()
        assert sorted(r["product_id"] for r in got) == sorted(r[1] for r in want[6 * (page - 1):6 * page])
        assert {(r["page"], r["total_pages"]) for r in got} == {(page, 17)}
    assert store.read(18).count() == 0 and store.read(0).count() == 0


def test_a_page_reads_its_part_only(spark, base):
    df = spark.range(1000).select(F.format_string("n%05d", "id").alias("name"), F.col("id").alias("product_id"))
    page = PageStore(spark, base).write(df, ["name", "product_id"], rows_in_part=100).read(50)
    assert page.count() == 6
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "GreaterThanOrEqual(name,n00294)" in plan
    assert "Exchange" not in plan and "Sort" not in plan


def test_pages_of_an_empty_listing(spark, base):
    store = PageStore(spark, base).write(spark.createDataFrame([], "name string, product_id long"), ["name", "product_id"])
    assert store.total_pages() == 0 and store.read(1).columns == ["name", "product_id", "page", "total_pages"]
    assert store.read(1).count() == 0


# ---- refusals --------------------------------------------------------------------------------
def test_accepted_and_refused_are_all_submitted(spark, sf_small, base):
    products = tables(spark, sf_small).data_products
    ref = products.select(F.min("product_ref")).first()[0]
    rows = [(1, ref, "a@x.org", "why"), (2, None, None, " "), (3, "DP-none", "a@x.org", "why"), (4, ref, "", "why"),
            (5, "", "a@x.org", None), (1, ref, "a@x.org", "why")]
    sub = spark.createDataFrame(rows, "submission_id long, product_ref string, requester_email string, reason string")
    names = [R.REF_MISSING, R.EMAIL_MISSING, R.REASON_MISSING, R.PRODUCT_UNKNOWN]
    out = R.split(R.judge_requests(sub, products), names, base)
    assert sorted(r["submission_id"] for r in out.accepted.collect()) == [1, 1]
    assert {r["submission_id"]: r["reasons"] for r in out.refused.collect()} == {
        2: names[:3], 3: [R.PRODUCT_UNKNOWN], 4: [R.EMAIL_MISSING], 5: [R.REF_MISSING, R.REASON_MISSING]}
    assert out.counts == {"submitted": 6, "accepted": 2, "refused": 4, R.REF_MISSING: 2, R.EMAIL_MISSING: 2,
                          R.REASON_MISSING: 2, R.PRODUCT_UNKNOWN: 1}
    again = CH.submit_requests(tables(spark, sf_small).access_requests, tables(spark, sf_small).users, products,
                               sub.withColumn("team", F.lit(None).cast("string")), requests_as_of())
    assert sorted(r["submission_id"] for r in again["refused"].collect()) == [2, 3, 4, 5]


def test_split_of_no_rows(spark, base):
    sub = spark.createDataFrame([], "submission_id long, name string, description string")
    out = R.split(R.judge_registrations(sub), [R.NAME_MISSING], base)
    assert out.counts == {"submitted": 0, "accepted": 0, "refused": 0, R.NAME_MISSING: 0}
    assert out.accepted.count() == 0 and out.refused.columns == ["submission_id", "name", "description", "reasons"]


def test_imports_of_registered_tables(spark, sf_small):
    products = spark.createDataFrame([("c.s.T",), ("",), (None,), ("c.s.T",)], "uc_full_name string")
    sel = spark.createDataFrame([("C.S.t",), ("c.s.u",), ("",), (None,)], "full_name string")
    got = sorted((r["full_name"] or "-", r["reasons"]) for r in R.judge_imports(sel, products).collect())
    assert got == [("-", [R.TABLE_MISSING]), ("-", [R.TABLE_MISSING]), ("C.S.t", [R.REGISTERED]), ("c.s.u", [])]
