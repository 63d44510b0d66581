"""Text column expressions (all JVM-side, codegen-friendly, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


WS = r"[ \t\n\x0B\f\r]"

# The rule patterns use \b in the ASCII sense (as in the reference's engine
# and in RE2); the JVM's \b also treats accented letters as word characters,
# so for rlike it is spelled out as an ASCII boundary.
_W = "[A-Za-z0-9_]"
ASCII_BOUNDARY = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def jvm_regex(pattern: str) -> str:
    """A rule pattern for the JVM regex engine with ASCII word boundaries."""
    return pattern.replace("\\b", ASCII_BOUNDARY)


def js_trim(s: Column | str) -> Column:
    """Trim all ASCII white space from both ends (not only blanks)."""
    return F.regexp_replace(_c(s), rf"^{WS}+|{WS}+$", "")


def word_caps(s: Column | str) -> Column:
    """Upper-case the first character of every ASCII word, keep the rest as is."""
    chunks = F.regexp_extract_all(_c(s), F.lit(r"(\w+|\W+)"), 1)
    return F.array_join(
        F.transform(
            chunks,
            lambda w: F.when(w.rlike(r"^\w"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
            .otherwise(w),
        ),
        "",
    )


def display_name(table_name: Column | str) -> Column:
    """``sales_gold_orders`` -> ``Sales Orders``: underscores to blanks, drop the
    first whole word 'gold' (case-insensitive), trim, capitalise words."""
    s = F.regexp_replace(_c(table_name), "_", " ")
    s = F.regexp_replace(s, jvm_regex(r"(?i)^(.*?)\bgold\b"), "$1")
    return word_caps(F.trim(s))


def name_from_email(email: Column | str) -> Column:
    """Local part of an e-mail, '.' and '_' to blanks, words capitalised."""
    local = F.substring_index(_c(email), "@", 1)
    return word_caps(F.translate(local, "._", "  "))


def parse_tags(tags_text: Column | str) -> Column:
    """``{a,"b"}`` text to an array: strip braces and quotes, split on comma,
    trim, drop empty entries."""
    parts = F.split(F.regexp_replace(_c(tags_text), r'[{}"]', ""), ",")
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def tags_from_input(tags_text: Column | str) -> Column:
    """Comma string to a trimmed array (inner empty entries are kept); an
    absent or empty input gives an empty array."""
    t = _c(tags_text)
    return F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(t, ","), lambda x: F.trim(x)))


def strip_markdown(text: Column | str) -> Column:
    """Bold, italic, headings and bullets to plain text (whole text, multi-line)."""
    s = F.coalesce(_c(text), F.lit(""))
    marked = F.regexp_replace(s, r"\*\*(.+?)\*\*", "$1")
    marked = F.regexp_replace(marked, r"\*(.+?)\*", "$1")
    marked = F.regexp_replace(marked, rf"(?m)^#+{WS}+", "")
    marked = F.regexp_replace(marked, rf"(?m)^[*\-]{WS}+", "• ")
    # Each pass needs one of three signs, which few texts have.
    return js_trim(F.when(s.contains("*") | s.contains("#") | s.contains("-"), marked).otherwise(s))


def prompt_line(ref, name, domain, type_, description, tags) -> Column:
    """``ref | name | domain | type | first 120 chars of description | tags``."""
    return F.concat_ws(
        " | ",
        _c(ref), _c(name),
        F.coalesce(_c(domain), F.lit("Other")),
        F.coalesce(_c(type_), F.lit("Dataset")),
        F.substring(F.coalesce(_c(description), F.lit("")), 1, 120),
        F.coalesce(F.array_join(_c(tags), ", "), F.lit("")),
    )


def is_question(q: Column | str) -> Column:
    """At least 3 words and a question verb first, or an analytic phrase."""
    q = _c(q)
    n_words = F.size(F.filter(F.split(js_trim(q), rf"{WS}+"), lambda w: w != ""))
    return F.coalesce(
        (n_words >= 3)
        & (js_trim(q).rlike(jvm_regex("(?i)" + rules.QUESTION_START))
           | q.rlike(jvm_regex("(?i)" + rules.QUESTION_PHRASE))),
        F.lit(False),
    )


def classify_intent(text: Column | str) -> Column:
    """First matching intent on the lower-cased text."""
    q = F.lower(_c(text))
    expr = None
    for name, pattern in rules.INTENT_RULES:
        expr = (F.when(q.rlike(pattern), name) if expr is None else expr.when(q.rlike(pattern), name))
    return expr.otherwise(rules.INTENT_DEFAULT)


def find_keywords(text: Column | str) -> Column:
    """Keywords of a 'find' request: stop phrases removed, words over 2 chars."""
    q = F.lower(_c(text))
    stripped = js_trim(F.regexp_replace(q, rules.FIND_STOP_PHRASES, ""))
    return F.filter(F.split(stripped, rf"{WS}+"), lambda w: F.length(w) >= rules.FIND_MIN_KEYWORD_LEN)
