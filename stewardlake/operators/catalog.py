"""Catalog browsing: listings, search, facets, paging, top-k (P*, A1, A11, A14, L1, L6, L7).

All functions are lazy ``DataFrame -> DataFrame`` transforms. Filters are
plain column predicates so Catalyst pushes them into the parquet scan;
top-k uses ``orderBy().limit()`` (TakeOrderedAndProject: a per-partition
heap, never a full sort).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import parse_tags

PRODUCT_COLUMNS = [
    "product_id", "product_ref", "uc_full_name", "display_name", "description", "type", "domain", "tags",
    "source_system", "refresh_frequency", "owner_email", "classification", "is_active", "status",
    "created_at", "updated_at", "last_refreshed", "source_type", "product_url", "report_url",
]

# Optional columns an older table may lack, with their typed defaults.
OPTIONAL_DEFAULTS = {
    "owner_email": "string", "classification": "string", "data_classification": "string",
    "created_at": "timestamp_ntz", "updated_at": "timestamp_ntz", "last_refreshed": "timestamp_ntz",
    "source_type": "string", "product_url": "string", "report_url": "string",
}


def align_schema(products: DataFrame) -> DataFrame:
    """Add absent optional columns as typed NULLs, then the COALESCE
    defaults: source_type <- source_system <- the default source; urls <- ''."""
    df = products
    for name, typ in OPTIONAL_DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(typ))
    return (
        df.withColumn("source_type", F.coalesce("source_type", "source_system", F.lit(rules.DEFAULT_SOURCE_TYPE)))
        .withColumn("product_url", F.coalesce("product_url", F.lit("")))
        .withColumn("report_url", F.coalesce("report_url", F.lit("")))
    )


def _status() -> Column:
    return F.coalesce(F.col("status"), F.lit("Published"))


def _listing(products: DataFrame, predicate: Column | None) -> DataFrame:
    df = align_schema(products)
    if predicate is not None:
        df = df.filter(predicate)
    return df.select(*PRODUCT_COLUMNS).withColumn("status", _status())


def catalog_published(products: DataFrame) -> DataFrame:
    """Active AND COALESCE(status,'Published') = 'Published'."""
    return _listing(products, F.col("is_active") & (_status() == "Published"))


def catalog_admin(products: DataFrame) -> DataFrame:
    """Every product, no status filter."""
    return _listing(products, None)


def catalog_active_or_pending(products: DataFrame) -> DataFrame:
    """Active OR COALESCE(status,'Published') = 'Pending'."""
    return _listing(products, F.col("is_active") | (_status() == "Pending"))


def catalog_by_domain_type(listing: DataFrame, domain: str | None = None, type_: str | None = None) -> DataFrame:
    """Optional equality on domain and type."""
    df = listing
    if domain:
        df = df.filter(F.col("domain") == domain)
    if type_:
        df = df.filter(F.col("type") == type_)
    return df


def catalog_ilike(listing: DataFrame, q: str) -> DataFrame:
    """P5: display_name or description ILIKE %q%."""
    pat = f"%{q}%"
    return listing.filter(F.col("display_name").ilike(pat) | F.col("description").ilike(pat))


def normalize_products(products: DataFrame) -> DataFrame:
    """The page's normal form with its defaults."""
    df = align_schema(products)
    return df.select(
        "product_id", "product_ref",
        F.col("display_name").alias("name"),
        F.coalesce("domain", F.lit("Other")).alias("category"),
        F.coalesce("type", F.lit("Dashboard")).alias("type"),
        F.coalesce("source_system", F.lit("-")).alias("source"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("refresh_frequency", F.lit("Daily")).alias("refresh_frequency"),
        F.coalesce("owner_email", F.lit("-")).alias("owner"),
        "last_refreshed",
        "uc_full_name",
        F.coalesce("source_type", F.lit(rules.DEFAULT_SOURCE_TYPE)).alias("source_type"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        _status().alias("status"),
    )


def normalize_insights(products: DataFrame, tags_text_col: str | None = None) -> DataFrame:
    """P20: like P19 with type default 'Dataset' and tags parsed from text."""
    df = align_schema(products)
    tags = parse_tags(F.col(tags_text_col)) if tags_text_col else F.coalesce("tags", F.array().cast("array<string>"))
    return df.select(
        F.col("product_ref").alias("ref"),
        F.col("display_name").alias("name"),
        F.coalesce("type", F.lit("Dataset")).alias("type"),
        F.coalesce("domain", F.lit("Other")).alias("domain"),
        tags.alias("tags"),
        F.coalesce("refresh_frequency", F.lit("Daily")).alias("refresh_frequency"),
        "last_refreshed",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("uc_full_name", F.lit("")).alias("uc_full_name"),
    )


def catalog_all_words(norm: DataFrame, q: str) -> DataFrame:
    """Every whitespace word of q occurs (case-insensitive) in the name,
    description, any tag, category or source."""
    words = [w for w in q.lower().split() if w]
    if not words:
        return norm
    hay = [F.lower("name"), F.lower("description"), F.lower("category"), F.lower("source")]

    def hit(w: Column) -> Column:
        any_field = hay[0].contains(w)
        for h in hay[1:]:
            any_field = any_field | h.contains(w)
        return any_field | F.exists("tags", lambda t: F.lower(t).contains(w))

    return norm.filter(F.forall(F.array(*[F.lit(w) for w in words]), hit))


def catalog_facet_filter(norm: DataFrame, category: str = "All", type_: str = "All",
                         source: str = "All", tag: str = "All") -> DataFrame:
    """Each facet is 'All' or an equality (tag: membership)."""
    df = norm
    if category != "All":
        df = df.filter(F.col("category") == category)
    if type_ != "All":
        df = df.filter(F.col("type") == type_)
    if source != "All":
        df = df.filter(F.col("source_type") == source)
    if tag != "All":
        df = df.filter(F.array_contains("tags", tag))
    return df


def catalog_page(norm: DataFrame, page: int, order: list[str] | None = None) -> DataFrame:
    """Page ``page`` (1-based) of PAGE_SIZE rows plus the total page count.

    The total is a scalar subquery (one aggregate), not a window over all rows.
    """
    order = order or ["name", "product_id"]
    size = rules.PAGE_SIZE
    total = norm.select(F.ceil(F.count(F.lit(1)) / F.lit(float(size))).cast("long").alias("t")).scalar()
    return (
        norm.orderBy(*order).offset(size * (page - 1)).limit(size)
        .withColumn("page", F.lit(page)).withColumn("total_pages", total)
    )


def products_pending(products: DataFrame) -> DataFrame:
    """is_active = FALSE AND status = 'Pending'."""
    return _listing(products, (~F.col("is_active")) & (F.col("status") == "Pending"))


def products_review_queue(products: DataFrame) -> DataFrame:
    """P10: status Pending OR is_active = FALSE."""
    return _listing(products, (F.col("status") == "Pending") | (~F.col("is_active")))


def products_search_admin(products: DataFrame, q: str) -> DataFrame:
    """Lower-case substring on name, domain or ref."""
    w = q.lower()
    return _listing(
        products,
        F.lower(F.coalesce("display_name", F.lit(""))).contains(w)
        | F.lower(F.coalesce("domain", F.lit(""))).contains(w)
        | F.lower(F.coalesce("product_ref", F.lit(""))).contains(w),
    )


def registered_names(products: DataFrame) -> DataFrame:
    """Non-null, non-empty uc_full_name."""
    return products.filter(F.col("uc_full_name").isNotNull() & (F.col("uc_full_name") != "")).select(
        "product_id", "product_ref", "uc_full_name")


def real_products(products: DataFrame) -> DataFrame:
    """uc_full_name NOT NULL and NOT LIKE the placeholder pattern."""
    return products.filter(
        F.col("uc_full_name").isNotNull() & ~F.col("uc_full_name").like(rules.PLACEHOLDER_NAME_LIKE)
    ).select("product_id", "product_ref", "uc_full_name", "status", "is_active")


def top_domains(published: DataFrame, k: int = 5) -> DataFrame:
    """A1: products per COALESCE(domain,'Other'), the k largest. Ties keep the
    order in which the page first meets each domain in its name-sorted list
    (its stable sort over insertion order), i.e. by the domain's first
    display name."""
    return (
        published.groupBy(F.coalesce("domain", F.lit("Other")).alias("domain"))
        .agg(F.count(F.lit(1)).alias("n_products"), F.min("display_name").alias("_first"))
        .orderBy(F.desc("n_products"), F.asc("_first"), F.asc("domain"))
        .limit(k)
        .drop("_first")
    )


def facets(norm: DataFrame) -> DataFrame:
    """(facet, value, ord) for categories, types (in taxonomy order, with
    their position), sources and tags (exploded, the import-method tag
    dropped). One scan: every product emits its (facet, value) pairs, which
    one distinct aggregate (partial per partition) reduces."""
    pair = lambda f, v: F.struct(F.lit(f).alias("facet"), v.alias("value"))
    pairs = F.concat(
        F.array(pair("category", F.col("category")), pair("source", F.col("source_type")), pair("type", F.col("type"))),
        F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: pair("tag", t)),
    )
    v, f = F.col("value"), F.col("facet")
    keep = (
        v.isNotNull() & (v != "")
        & ((f != "tag") | (v != rules.FACET_TAG_EXCLUDED))
        & ((f != "type") | v.isin(*rules.PRODUCT_TYPES))
    )
    rank = F.array_position(F.array(*[F.lit(t) for t in rules.PRODUCT_TYPES]), v).cast("int")
    return (
        norm.select(F.inline(pairs)).filter(keep).distinct()
        .withColumn("ord", F.when(f == "type", rank).otherwise(F.lit(None).cast("int")))
    )


def draft_count(products: DataFrame) -> DataFrame:
    """Number of Draft products and the admin tab counts, one row."""
    st = _status()
    return products.agg(
        F.count_if(st == "Draft").alias("drafts"),
        F.count_if(st == "Pending").alias("pending"),
        F.count_if(st == "Published").alias("published"),
        F.count(F.lit(1)).alias("all_products"),
    )


def featured_products(published: DataFrame, k: int = 3) -> DataFrame:
    """L1: the k most recently updated (NULL as epoch), ties by name."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return published.orderBy(
        F.desc(F.coalesce("updated_at", epoch)), F.asc("display_name"), F.asc("product_id")
    ).limit(k)


def ask_context(published: DataFrame, n: int = 60) -> DataFrame:
    """The first n published products by display name."""
    return published.orderBy("display_name", "product_id").limit(n)


def sorted_catalog(norm: DataFrame, sort_by: str = "Most Recent") -> DataFrame:
    """Most Recent / Name A-Z / Name Z-A."""
    if sort_by == "Name A-Z":
        return norm.orderBy(F.asc("name"), F.asc("product_id"))
    if sort_by == "Name Z-A":
        return norm.orderBy(F.desc("name"), F.asc("product_id"))
    return norm.orderBy(F.desc_nulls_last("last_refreshed"), F.asc("name"), F.asc("product_id"))


def next_product_ref(products: DataFrame) -> DataFrame:
    """MAX of the integer after 'DP-', plus one (0 when none)."""
    num = F.substring("product_ref", 4, 1 << 20).try_cast("bigint")
    return products.agg(F.max(num).alias("max_id")).select(
        "max_id",
        F.format_string("DP-%03d", F.coalesce(F.col("max_id"), F.lit(0)) + 1).alias("next_ref"),
    )


def preview_rows(table: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The first n rows of a table in key order (stable)."""
    return table.orderBy(*key).limit(n)


def starter_query_rows(table: DataFrame, key: list[str], n: int = 100) -> DataFrame:
    """The suggested SELECT * .. LIMIT 100, in key order."""
    return table.orderBy(*key).limit(n)
