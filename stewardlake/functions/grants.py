"""Grant / revoke statement text and audit metadata, as column expressions.

Open-source Spark has no GRANT, so the jobs emit the statements as data.
Identifiers are back-quoted part by part with embedded back-quotes doubled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quote_ident(s: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(s, F.lit("`"), F.lit("``")), F.lit("`"))


def quote_table_name(full_name: Column) -> Column:
    """``a.b.c`` -> `` `a`.`b`.`c` ``."""
    return F.array_join(F.transform(F.split(full_name, r"\."), quote_ident), ".")


def grant_sql(uc_full_name: Column | str, requester_email: Column | str, product_name: Column | str) -> Column:
    full = _c(uc_full_name)
    no_table = F.concat(
        F.lit(rules.NO_TABLE_GRANT_COMMENT.split("{name}")[0]),
        F.coalesce(_c(product_name), F.lit("")),
        F.lit(rules.NO_TABLE_GRANT_COMMENT.split("{name}")[1]),
    )
    return (
        F.when((full.isNull()) | (full == ""), no_table)
        .otherwise(F.concat(F.lit("GRANT SELECT ON "), quote_table_name(full), F.lit(" TO "),
                            quote_ident(_c(requester_email)), F.lit(";")))
    )


def revoke_sql(grant_text: Column | str) -> Column:
    """Leading GRANT -> REVOKE and the first ' TO ' -> ' FROM '."""
    g = _c(grant_text)
    r = F.regexp_replace(g, r"^GRANT", "REVOKE")
    r = F.regexp_replace(r, r"(?s)^(.*?) TO ", "$1 FROM ")
    return F.when((g.isNull()) | (g == ""), F.lit(rules.NO_TABLE_REVOKE_COMMENT)).otherwise(r)


def catalog_grant_lines(catalog: Column | str, principal: Column | str) -> Column:
    """The three GRANT lines that open a catalog to a principal (array)."""
    cat, who = quote_ident(_c(catalog)), quote_ident(_c(principal))
    return F.array(*[
        F.concat(F.lit(f"GRANT {p} ON CATALOG "), cat, F.lit(" TO "), who, F.lit(";"))
        for p in rules.CATALOG_GRANT_PRIVILEGES
    ])


def audit_metadata(**fields: Column) -> Column:
    """JSON text of the given fields (key order as given)."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
