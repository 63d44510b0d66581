"""Registered queries over the stored substring index (P5, P6, P11 for batches of search texts)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import changes as CH
from ..operators import textindex as X
from ..operators.common import fixed, spread
from ..session import checkpoint_subdir
from ..sources.fixtures import tables
from .params import requests_as_of
from .registry import register

# The index is built over the catalog as it was, then two batches come in as deltas: every Report gets its domain
# in lower case and loses its description (M3), and pending products are deleted (M4).
AFTER = """after AS (
 SELECT product_id, product_ref, display_name, CASE WHEN type = 'Report' THEN NULL ELSE description END AS description,
  CASE WHEN type = 'Report' THEN lower(domain) ELSE domain END AS domain, source_system, tags
 FROM data_products WHERE status IS DISTINCT FROM 'Pending')"""


def _snapshots(t):
    before = t.data_products
    reports = before.filter(F.col("type") == "Report").select(
        "product_ref", F.lit(1).alias("patch_seq"), F.lit(True).alias("has_domain"), F.lower("domain").alias("domain"),
        F.lit(True).alias("has_description"), F.lit(None).cast("string").alias("description"))
    patched = CH.patch_products(before, reports, requests_as_of())
    refs = patched.filter(F.col("status") == "Pending").select("product_ref")
    after = CH.delete_products(refs, patched, t.access_requests, t.audit_log, t.user_library)["data_products"]
    return before, patched, after


def _version(df):
    """A snapshot written once, as a table version would be, in parts of a bounded number of products: steps that read
    it have as many tasks, however few the files of the catalog were."""
    return fixed(spread(df, F.col("product_id")))


def _index(spark, t):
    before, patched, after = (_version(df) for df in _snapshots(t))
    index = X.StoredIndex(spark, checkpoint_subdir(spark, f"index-{uuid.uuid4().hex[:12]}")).build(before)
    index.apply(*X.changed(before, patched), 1).compact()
    return index.apply(*X.changed(patched, after), 2), after


# Search texts from the catalog itself: pieces of names, in capitals, with a wildcard, two words, a short word, a word
# of a domain, a reference, and one that nothing has.
SEARCHES = """searches AS (
 SELECT 8 * product_id + k.i AS query_id, CASE k.i WHEN 0 THEN substr(display_name, 2, 5) WHEN 1 THEN upper(substr(display_name, 3, 6))
  WHEN 2 THEN substr(display_name, 1, 3) || '%' || substr(display_name, 6, 2)
  WHEN 3 THEN split_part(display_name, ' ', 2) || ' ' || lower(coalesce(domain, 'zz')) WHEN 4 THEN substr(display_name, 2, 2)
  WHEN 5 THEN lower(split_part(domain, ' ', 1)) WHEN 6 THEN substr(product_ref, 2) ELSE 'q' || display_name END AS q
 FROM data_products, (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) k(i) WHERE product_id % 9 = 1)"""


def _searches(t):
    name, domain = F.col("display_name"), F.col("domain")
    texts = [F.substring(name, 2, 5), F.upper(F.substring(name, 3, 6)),
             F.concat(F.substring(name, 1, 3), F.lit("%"), F.substring(name, 6, 2)),
             F.concat(F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" "), F.lower(F.coalesce(domain, F.lit("zz")))),
             F.substring(name, 2, 2), F.lower(F.split_part(domain, F.lit(" "), F.lit(1))),
             F.substr("product_ref", F.lit(2)), F.concat(F.lit("q"), name)]
    asked = t.data_products.where("product_id % 9 = 1").select("product_id", F.posexplode(F.array(*texts)).alias("i", "q"))
    return asked.select((8 * F.col("product_id") + F.col("i")).alias("query_id"), "q")


@register("search_index", f"""WITH {AFTER},
f AS (
 SELECT product_id, 'name' AS field, lower(display_name) AS x FROM after UNION ALL
 SELECT product_id, 'description', lower(COALESCE(description, '')) FROM after UNION ALL
 SELECT product_id, 'category', lower(COALESCE(domain, 'Other')) FROM after UNION ALL
 SELECT product_id, 'source', lower(COALESCE(source_system, '-')) FROM after UNION ALL
 SELECT product_id, 'ref', lower(product_ref) FROM after UNION ALL
 SELECT product_id, 'tags', lower(unnest(tags)) FROM after),
g AS (SELECT DISTINCT product_id, field, substr(x, i, n) AS gram FROM f, range(1, 200) r(i), range(1, 4) s(n) WHERE i + n - 1 <= length(x))
SELECT field, gram, product_id // 64 AS block, count(*) AS n_products, min(product_id) AS first_id, max(product_id) AS last_id
FROM g GROUP BY ALL""")
def q_search_index(spark, d):
    index, _ = _index(spark, tables(spark, d))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(
        F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    base = F.shiftleft("block", X.BITS)
    return index.read().select("field", "gram", "block", F.bit_count("bits").cast("long").alias("n_products"),
                               (base + F.array_min(bits)).alias("first_id"), (base + F.array_max(bits)).alias("last_id"))


@register("search_ilike", f"""WITH {AFTER}, {SEARCHES}
SELECT query_id, product_id FROM searches JOIN after ON display_name ILIKE '%' || q || '%' OR description ILIKE '%' || q || '%'""")
def q_search_ilike(spark, d):
    t = tables(spark, d)
    index, after = _index(spark, t)
    return X.search_ilike(index, _searches(t), after)


@register("search_words", f"""WITH {AFTER}, {SEARCHES},
w AS (SELECT query_id, list_filter(string_split_regex(lower(q), '\\s+'), lambda x: x != '') AS ws FROM searches WHERE q IS NOT NULL)
SELECT query_id, product_id FROM w JOIN after ON len(list_filter(ws, lambda x: NOT (
  contains(lower(display_name), x) OR contains(lower(COALESCE(description, '')), x) OR contains(lower(COALESCE(domain, 'Other')), x)
  OR contains(lower(COALESCE(source_system, '-')), x) OR contains(lower(array_to_string(tags, chr(31))), x)))) = 0""")
def q_search_words(spark, d):
    t = tables(spark, d)
    index, after = _index(spark, t)
    return X.search_words(index, _searches(t), after)


@register("search_admin", f"""WITH {AFTER}, {SEARCHES}
SELECT query_id, product_id FROM searches JOIN after ON contains(lower(COALESCE(display_name, '')), lower(q))
 OR contains(lower(COALESCE(domain, '')), lower(q)) OR contains(lower(COALESCE(product_ref, '')), lower(q))""")
def q_search_admin(spark, d):
    t = tables(spark, d)
    index, after = _index(spark, t)
    return X.search_admin(index, _searches(t), after)
