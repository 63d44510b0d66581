"""Registered catalog queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.classify import freshness
from ..functions.text import parse_tags, tags_from_input
from ..operators import catalog as C
from ..session import checkpoint_subdir
from ..sources import catalog_io as IO
from ..sources.fixtures import tables
from ..sources.pages import PageStore
from .params import FRESHNESS_AS_OF_TEXT, freshness_as_of
from .registry import register

DEFAULT_SOURCE = rules.DEFAULT_SOURCE_TYPE
TYPES_SQL = "[" + ", ".join(f"'{t}'" for t in rules.PRODUCT_TYPES) + "]"
ALIGNED = f"""aligned AS (
 SELECT product_id, product_ref, uc_full_name, display_name, description, type, domain, tags, source_system,
  refresh_frequency, CAST(NULL AS VARCHAR) AS owner_email, CAST(NULL AS VARCHAR) AS classification, is_active,
  COALESCE(status, 'Published') AS status, CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
  last_refreshed, COALESCE(source_system, '{DEFAULT_SOURCE}') AS source_type, '' AS product_url, '' AS report_url
 FROM data_products)"""
LIST_COLS = ("product_id, product_ref, uc_full_name, display_name, description, type, domain, array_to_string(tags, '|') AS tags, "
             "source_system, refresh_frequency, owner_email, classification, is_active, status, created_at, updated_at, "
             "last_refreshed, source_type, product_url, report_url")
PUBLISHED = "is_active AND status = 'Published'"
NORM = f"""norm AS (
 SELECT product_id, product_ref, display_name AS name, COALESCE(domain, 'Other') AS category, COALESCE(type, 'Dashboard') AS type,
  COALESCE(source_system, '-') AS source, COALESCE(description, '') AS description, COALESCE(refresh_frequency, 'Daily') AS refresh_frequency,
  COALESCE(owner_email, '-') AS owner, last_refreshed, uc_full_name, COALESCE(source_type, '{DEFAULT_SOURCE}') AS source_type,
  COALESCE(tags, []) AS tags, status
 FROM aligned WHERE {{where}})"""
NORM_COLS = ("product_id, product_ref, name, category, type, source, description, refresh_frequency, owner, last_refreshed, "
             "uc_full_name, source_type, array_to_string(tags, '|') AS tags, status")


def _norm_published(t):
    return C.normalize_products(C.catalog_published(t.data_products))


@register("load_catalog_tables", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in IO.CATALOG_TABLES))
def q_load_catalog_tables(spark, d):
    return IO.table_row_counts(IO.load_catalog_tables(spark, d))


@register("table_counts", "SELECT " + ", ".join(f"(SELECT count(*) FROM {n}) AS {n}" for n in IO.CATALOG_TABLES))
def q_table_counts(spark, d):
    return IO.table_counts(IO.load_catalog_tables(spark, d))


ALIGNED_RAW_STATUS = ALIGNED.replace("COALESCE(status, 'Published') AS status", "status")


@register("align_schema", f"WITH {ALIGNED_RAW_STATUS} SELECT {LIST_COLS}, CAST(NULL AS VARCHAR) AS data_classification FROM aligned")
def q_align_schema(spark, d):
    df = C.align_schema(tables(spark, d).data_products)
    return df.select(*C.PRODUCT_COLUMNS, "data_classification")


@register("catalog_published", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE {PUBLISHED}")
def q_catalog_published(spark, d):
    return C.catalog_published(tables(spark, d).data_products)


@register("catalog_admin", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned")
def q_catalog_admin(spark, d):
    return C.catalog_admin(tables(spark, d).data_products)


@register("catalog_active_or_pending", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE is_active OR status = 'Pending'")
def q_catalog_active_or_pending(spark, d):
    return C.catalog_active_or_pending(tables(spark, d).data_products)


@register("catalog_by_domain_type",
          f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE {PUBLISHED} AND domain = 'PROMO' AND type = 'Report'")
def q_catalog_by_domain_type(spark, d):
    return C.catalog_by_domain_type(C.catalog_published(tables(spark, d).data_products), "PROMO", "Report")


@register("catalog_ilike", f"""WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned
WHERE {PUBLISHED} AND (display_name ILIKE '%Red Wid%' OR description ILIKE '%Red Wid%')""")
def q_catalog_ilike(spark, d):
    return C.catalog_ilike(C.catalog_published(tables(spark, d).data_products), "Red Wid")


WORDS_Q = "red brand#1 economy"


def _all_words_sql(words):
    conds = []
    for w in words:
        conds.append(f"(contains(lower(name), '{w}') OR contains(lower(description), '{w}') OR contains(lower(category), '{w}')"
                     f" OR contains(lower(source), '{w}') OR len(list_filter(tags, lambda t: contains(lower(t), '{w}'))) > 0)")
    return " AND ".join(conds)


@register("catalog_all_words", f"""WITH {ALIGNED}, {NORM.format(where=PUBLISHED)}
SELECT {NORM_COLS} FROM norm WHERE {_all_words_sql(WORDS_Q.split())}""")
def q_catalog_all_words(spark, d):
    return C.catalog_all_words(_norm_published(tables(spark, d)), WORDS_Q)


@register("catalog_facet_filter", f"""WITH {ALIGNED}, {NORM.format(where=PUBLISHED)}
SELECT {NORM_COLS} FROM norm WHERE category = 'SMALL' AND type = 'Dashboard' AND list_contains(tags, 'gear')""")
def q_catalog_facet_filter(spark, d):
    return C.catalog_facet_filter(_norm_published(tables(spark, d)), category="SMALL", type_="Dashboard", tag="gear")


@register("catalog_page", f"""WITH {ALIGNED}, {NORM.format(where=PUBLISHED)},
f AS (SELECT * FROM norm WHERE type = 'Report')
SELECT {NORM_COLS}, 3 AS page, (SELECT CAST(ceil(count(*) / 6.0) AS BIGINT) FROM f) AS total_pages
FROM (SELECT * FROM f ORDER BY name, product_id LIMIT 6 OFFSET 12)""")
def q_catalog_page(spark, d):
    f = C.catalog_facet_filter(_norm_published(tables(spark, d)), type_="Report")
    return C.catalog_page(f, 3)


# Pages by a directory of boundary keys: the first three, the middle and the last page of all published products.
@register("catalog_page_lookup", f"""WITH {ALIGNED}, {NORM.format(where=PUBLISHED)},
s AS (SELECT *, (row_number() OVER (ORDER BY name, product_id) - 1) // 6 + 1 AS page,
 (SELECT CAST(ceil(count(*) / 6.0) AS BIGINT) FROM norm) AS total_pages FROM norm)
SELECT {NORM_COLS}, CAST(page AS BIGINT) AS page, total_pages FROM s
WHERE page IN (1, 2, 3, total_pages // 2 + 1, total_pages)""")
def q_catalog_page_lookup(spark, d):
    store = PageStore(spark, checkpoint_subdir(spark, f"pages_{uuid.uuid4().hex[:12]}")).write(
        _norm_published(tables(spark, d)), ["name", "product_id"])
    total = store.total_pages()
    asked = sorted({1, 2, 3, total // 2 + 1, total} & set(range(1, total + 1))) or [1]
    out = store.read(asked[0])
    for page in asked[1:]:
        out = out.unionByName(store.read(page))
    return out.withColumn("page", F.col("page").cast("long"))


@register("products_pending", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE NOT is_active AND status = 'Pending'")
def q_products_pending(spark, d):
    return C.products_pending(tables(spark, d).data_products)


@register("products_review_queue", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE status = 'Pending' OR NOT is_active")
def q_products_review_queue(spark, d):
    return C.products_review_queue(tables(spark, d).data_products)


@register("products_search_admin", f"""WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned
WHERE contains(lower(COALESCE(display_name, '')), 'dp-01') OR contains(lower(COALESCE(domain, '')), 'dp-01')
 OR contains(lower(COALESCE(product_ref, '')), 'dp-01')""")
def q_products_search_admin(spark, d):
    return C.products_search_admin(tables(spark, d).data_products, "DP-01")


@register("registered_names", "SELECT product_id, product_ref, uc_full_name FROM data_products WHERE uc_full_name IS NOT NULL AND uc_full_name <> ''")
def q_registered_names(spark, d):
    return C.registered_names(tables(spark, d).data_products)


@register("real_products", """SELECT product_id, product_ref, uc_full_name, status, is_active FROM data_products
WHERE uc_full_name IS NOT NULL AND uc_full_name NOT LIKE 'your_catalog.%'""")
def q_real_products(spark, d):
    return C.real_products(tables(spark, d).data_products)


@register("normalize_products", f"WITH {ALIGNED}, {NORM.format(where='TRUE')} SELECT {NORM_COLS} FROM norm")
def q_normalize_products(spark, d):
    return C.normalize_products(tables(spark, d).data_products)


@register("normalize_insights", f"""WITH {ALIGNED}
SELECT product_ref AS ref, display_name AS name, COALESCE(type, 'Dataset') AS type, COALESCE(domain, 'Other') AS domain,
 array_to_string(list_filter(list_transform(string_split(regexp_replace('{{"' || replace(tags_csv, ',', '","') || '"}}', '[{{}}"]', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags,
 COALESCE(refresh_frequency, 'Daily') AS refresh_frequency, last_refreshed, COALESCE(description, '') AS description,
 COALESCE(uc_full_name, '') AS uc_full_name
FROM aligned JOIN (SELECT product_id, tags_csv FROM data_products) USING (product_id) WHERE {PUBLISHED}""")
def q_normalize_insights(spark, d):
    t = tables(spark, d)
    prods = t.data_products.withColumn(
        "tags_text", F.concat(F.lit('{"'), F.replace(F.col("tags_csv"), F.lit(","), F.lit('","')), F.lit('"}')))
    pub = prods.filter(F.col("is_active") & (F.coalesce("status", F.lit("Published")) == "Published"))
    return C.normalize_insights(pub, tags_text_col="tags_text")


@register("top_domains", f"""WITH {ALIGNED}
SELECT domain, n_products FROM (
 SELECT COALESCE(domain, 'Other') AS domain, count(*) AS n_products, min(display_name) AS first_name FROM aligned WHERE {PUBLISHED}
 GROUP BY 1 ORDER BY n_products DESC, first_name, domain LIMIT 5)""")
def q_top_domains(spark, d):
    return C.top_domains(C.catalog_published(tables(spark, d).data_products), 5)


@register("facets", f"""WITH {ALIGNED}, {NORM.format(where=PUBLISHED)}
SELECT DISTINCT * FROM (
 SELECT 'category' AS facet, category AS value, CAST(NULL AS INTEGER) AS ord FROM norm WHERE category <> ''
 UNION ALL SELECT 'source', source_type, CAST(NULL AS INTEGER) FROM norm WHERE source_type <> ''
 UNION ALL SELECT 'tag', t, CAST(NULL AS INTEGER) FROM (SELECT unnest(tags) AS t FROM norm) WHERE t IS NOT NULL AND t <> '' AND t <> '{rules.FACET_TAG_EXCLUDED}'
 UNION ALL SELECT 'type', type, CAST(list_position({TYPES_SQL}, type) AS INTEGER)
  FROM norm WHERE list_contains({TYPES_SQL}, type))""")
def q_facets(spark, d):
    return C.facets(_norm_published(tables(spark, d)))


@register("draft_count", f"""WITH {ALIGNED}
SELECT count(*) FILTER (WHERE status = 'Draft') AS drafts, count(*) FILTER (WHERE status = 'Pending') AS pending,
 count(*) FILTER (WHERE status = 'Published') AS published, count(*) AS all_products FROM aligned""")
def q_draft_count(spark, d):
    return C.draft_count(tables(spark, d).data_products)


@register("featured_products", f"""WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE {PUBLISHED}
ORDER BY COALESCE(updated_at, TIMESTAMP '1970-01-01 00:00:00') DESC, display_name, product_id LIMIT 3""")
def q_featured_products(spark, d):
    return C.featured_products(C.catalog_published(tables(spark, d).data_products), 3)


@register("ask_context", f"WITH {ALIGNED} SELECT {LIST_COLS} FROM aligned WHERE {PUBLISHED} ORDER BY display_name, product_id LIMIT 60")
def q_ask_context(spark, d):
    return C.ask_context(C.catalog_published(tables(spark, d).data_products), 60)


@register("sorted_catalog", f"WITH {ALIGNED}, {NORM.format(where=PUBLISHED)} SELECT {NORM_COLS} FROM norm")
def q_sorted_catalog(spark, d):
    return C.sorted_catalog(_norm_published(tables(spark, d)), "Name Z-A")


@register("next_product_ref", """
SELECT max(TRY_CAST(substring(product_ref, 4) AS INTEGER)) AS max_id,
 printf('DP-%03d', COALESCE(max(TRY_CAST(substring(product_ref, 4) AS INTEGER)), 0) + 1) AS next_ref FROM data_products""")
def q_next_product_ref(spark, d):
    return C.next_product_ref(tables(spark, d).data_products)


@register("freshness", f"""
SELECT product_id, refresh_frequency, last_refreshed,
 CASE WHEN last_refreshed IS NULL THEN NULL
  WHEN age <= thr * 0.5 THEN 'Fresh' WHEN age <= thr THEN 'Recent' WHEN age <= thr * 2 THEN 'Stale' ELSE 'Outdated' END AS freshness
FROM (SELECT product_id, refresh_frequency, last_refreshed,
  date_diff('microsecond', last_refreshed, TIMESTAMP '{FRESHNESS_AS_OF_TEXT}') / 86400000000.0 AS age,
  CASE COALESCE(refresh_frequency, 'Daily') WHEN 'Daily' THEN 1.5 WHEN 'Weekly' THEN 8.0 WHEN 'Monthly' THEN 32.0 WHEN 'Annual' THEN 370.0 ELSE 3.0 END AS thr
 FROM data_products)""")
def q_freshness(spark, d):
    p = tables(spark, d).data_products
    return p.select("product_id", "refresh_frequency", "last_refreshed",
                    freshness("last_refreshed", F.coalesce("refresh_frequency", F.lit("Daily")), freshness_as_of())
                    .alias("freshness"))


@register("parse_tags", """
SELECT product_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(
 '{"' || replace(tags_csv, ',', '","') || '"}', '[{}"]', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> ''), '|') AS tags
FROM data_products""")
def q_parse_tags(spark, d):
    p = tables(spark, d).data_products
    text = F.concat(F.lit('{"'), F.replace(F.col("tags_csv"), F.lit(","), F.lit('","')), F.lit('"}'))
    return p.select("product_id", parse_tags(text).alias("tags"))


@register("tags_from_input", """
SELECT product_id, array_to_string(list_transform(string_split(replace(tags_csv, ',', ' , '), ','), lambda t: trim(t)), '|') AS tags
FROM data_products""")
def q_tags_from_input(spark, d):
    p = tables(spark, d).data_products
    return p.select("product_id", tags_from_input(F.replace(F.col("tags_csv"), F.lit(","), F.lit(" , "))).alias("tags"))


@register("preview_rows", """
SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""")
def q_preview_rows(spark, d):
    t = tables(spark, d)
    return C.preview_rows(t.raw("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5)


@register("starter_query_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
def q_starter_query_rows(spark, d):
    return C.starter_query_rows(tables(spark, d).raw("orders"), ["o_orderkey"], 100)
