"""Classification column expressions: sensitivity, domain, role, freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_sensitivity(column_name: Column | str, tags: Column | str | None = None) -> Column:
    """Tag ``sensitivity_level`` or ``sensitivity`` wins (upper-cased, empty is
    absent); otherwise the name prefix decides PII, then CONFIDENTIAL, else
    INTERNAL. ``tags`` is a map<string,string> of column tags (or None)."""
    name = _c(column_name)
    by_name = (
        F.when(name.rlike("(?i)" + rules.PII_NAME_PREFIX), "PII")
        .when(name.rlike("(?i)" + rules.CONFIDENTIAL_NAME_PREFIX), "CONFIDENTIAL")
        .otherwise("INTERNAL")
    )
    if tags is None:
        return by_name
    t = _c(tags)
    tagged = F.upper(F.coalesce(*[F.nullif(t.getItem(k), F.lit("")) for k in rules.SENSITIVITY_TAG_NAMES]))
    return F.coalesce(F.nullif(tagged, F.lit("")), by_name)


def masked(sensitivity: Column | str) -> Column:
    s = _c(sensitivity)
    return s.isin("PII", "CONFIDENTIAL")


def elevated_pii(sensitivity: Column | str, column_name: Column | str) -> Column:
    """PII whose name also matches the PII prefix and an identity word."""
    s, name = _c(sensitivity), _c(column_name)
    return (
        (s == "PII")
        & name.rlike("(?i)" + rules.PII_NAME_PREFIX)
        & name.rlike("(?i)" + rules.ELEVATED_PII_NAME)
    )


def infer_domain(catalog_name: Column | str, schema_name: Column | str) -> Column:
    """Ordered substring rules on lower('catalog schema'); first match wins."""
    s = F.lower(F.concat_ws(" ", F.coalesce(_c(catalog_name), F.lit("")), F.coalesce(_c(schema_name), F.lit(""))))
    expr = None
    for pattern, domain in rules.DOMAIN_RULES:
        expr = F.when(s.rlike(pattern), domain) if expr is None else expr.when(s.rlike(pattern), domain)
    return expr.otherwise(rules.DOMAIN_DEFAULT)


def normalize_role(role: Column | str) -> Column:
    r = F.lower(F.trim(_c(role)))
    return F.when(r.isin(*rules.ADMIN_ROLE_ALIASES), "admin").otherwise("analyst")


def freshness(last_refreshed: Column | str, frequency: Column | str, as_of: Column) -> Column:
    """Fresh / Recent / Stale / Outdated from the age in (fractional) days
    against the frequency's threshold; NULL last_refreshed stays NULL."""
    lr, freq = _c(last_refreshed), _c(frequency)
    age_days = F.timestamp_diff("MICROSECOND", lr, as_of) / F.lit(86_400_000_000.0)
    thr = None
    for name, d in rules.FRESHNESS_DAYS:
        thr = F.when(freq == name, F.lit(d)) if thr is None else thr.when(freq == name, F.lit(d))
    thr = thr.otherwise(F.lit(rules.FRESHNESS_DEFAULT_DAYS))
    return (
        F.when(lr.isNull(), F.lit(None).cast("string"))
        .when(age_days <= thr * 0.5, "Fresh")
        .when(age_days <= thr, "Recent")
        .when(age_days <= thr * 2, "Stale")
        .otherwise("Outdated")
    )
