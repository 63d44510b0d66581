"""Registered text and search queries (F14-F18, X1, X2) over the catalog,
the conversation log (user turns as questions) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import prompt_line
from ..operators import catalog as C
from ..operators import search as S
from ..sources.fixtures import tables
from .registry import register

WS = "[ \\t\\n\\x0B\\f\\r]"
PUB = """pub AS (SELECT * FROM data_products WHERE is_active AND COALESCE(status, 'Published') = 'Published')"""
QUESTIONS = "q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')"


def js_trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))"


def intent_sql(x: str) -> str:
    # FIXED VALUES, stated here once more so that the oracles do not share the library's rule tables.
    return f"""CASE WHEN regexp_matches(lower({x}), 'approval|waiting on me|pending approval|queue|review|need.*approve') THEN 'approvals'
 WHEN regexp_matches(lower({x}), 'status|check.*request|my request|pending|approved|denied') THEN 'status'
 WHEN regexp_matches(lower({x}), 'nudge|remind|follow.?up|ping|chase|hasn.?t|haven.?t heard') THEN 'nudge'
 WHEN regexp_matches(lower({x}), 'what.*access|my.*data|can.*access|have access|library|approved') THEN 'access'
 WHEN regexp_matches(lower({x}), 'who.*approve|who.*own|data steward|data owner|approver|contact') THEN 'owner'
 WHEN regexp_matches(lower({x}), 'find|search|look for|do we have|is there|data about|dataset') THEN 'find'
 WHEN regexp_matches(lower({x}), 'how.*request|request.*access|get access|apply|submit') THEN 'how_to'
 WHEN regexp_matches(lower({x}), '^(hi|hello|hey|help|what can you|what do you)') THEN 'greeting' ELSE 'fallback' END"""


QUESTION_START = r"^(show|find|what|which|how|give|get|list|compare|who|why|tell|analyze|summarize|break|top|total|average|trend|where)\b"
QUESTION_PHRASE = r"\b(by department|by team|over time|last year|this year|vs |versus|trend|breakdown|summary|analysis|compared to)\b"
FIND_PHRASES = "find|search|look for|do we have|is there|data about|dataset|any"


PROMPT_LINE_SQL = ("concat_ws(' | ', product_ref, display_name, COALESCE(domain, 'Other'), COALESCE(type, 'Dataset'), "
                   "substr(COALESCE(description, ''), 1, 120), COALESCE(array_to_string(tags, ', '), ''))")


@register("prompt_line", f"WITH {PUB} SELECT product_id, {PROMPT_LINE_SQL} AS line FROM pub")
def q_prompt_line(spark, d):
    pub = C.catalog_published(tables(spark, d).data_products)
    return pub.select("product_id", prompt_line("product_ref", "display_name", "domain", "type", "description", "tags").alias("line"))


@register("ask_prompt_table", f"""WITH {PUB}, {QUESTIONS},
ctx AS (SELECT * FROM pub ORDER BY display_name, product_id LIMIT 60),
blk AS (SELECT string_agg({PROMPT_LINE_SQL}, chr(10) ORDER BY display_name, product_id) AS b FROM ctx)
SELECT conv_id, turn, 'User question: "' || text || '"' || chr(10) || chr(10) ||
 'Catalog (format: ref | name | domain | type | description | tags):' || chr(10) || b AS prompt FROM q, blk""")
def q_ask_prompt_table(spark, d):
    t = tables(spark, d)
    ctx = C.ask_context(C.catalog_published(t.data_products), 60)
    return S.ask_prompt_table(S.question_turns(t.conversations), ctx)


@register("is_question", f"""WITH {QUESTIONS}
SELECT conv_id, turn,
 COALESCE(len(list_filter(regexp_split_to_array({js_trim_sql('text')}, '{WS}+'), lambda w: w <> '')) >= 3
  AND (regexp_matches({js_trim_sql('text')}, '(?i){QUESTION_START}') OR regexp_matches(text, '(?i){QUESTION_PHRASE}')), FALSE)
  AS is_question,
 {intent_sql('text')} AS intent
FROM q""")
def q_is_question(spark, d):
    return S.question_flags(S.question_turns(tables(spark, d).conversations))


@register("classify_intent", f"WITH {QUESTIONS} SELECT conv_id, turn, {intent_sql('text')} AS intent FROM q")
def q_classify_intent(spark, d):
    return S.question_flags(S.question_turns(tables(spark, d).conversations)).select("conv_id", "turn", "intent")


# Questions: the user turns, each user turn as a "find" question, and "find" with the name of every published product
# (conv_id = its id, turn -1) and with every category (turn -2).
@register("find_keywords", f"""WITH {PUB},
q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn + 1000000000, 'find ' || text FROM conversations WHERE role = 'user'
  UNION ALL SELECT product_id, -1, 'find ' || display_name FROM pub
  UNION ALL SELECT min(product_id), -2, 'find ' || COALESCE(domain, 'Other') FROM pub GROUP BY COALESCE(domain, 'Other')),
fq AS (SELECT * FROM q WHERE {intent_sql('text')} = 'find'),
kw AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(
  {js_trim_sql(f"regexp_replace(lower(text), '{FIND_PHRASES}', '', 'g')")}, '{WS}+'), lambda w: length(w) >= 3)) AS kw FROM fq),
np AS (SELECT product_id, display_name AS name, lower(display_name) AS lname, lower(COALESCE(domain, 'Other')) AS category FROM pub),
k AS (SELECT DISTINCT kw FROM kw),
km AS (SELECT k.kw, product_id, name FROM k JOIN np ON contains(np.lname, k.kw) OR contains(np.category, k.kw)),
m AS (SELECT DISTINCT conv_id, turn, product_id, name FROM kw JOIN km USING (kw)),
r AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS n_matches,
       row_number() OVER (PARTITION BY conv_id, turn ORDER BY name, product_id) AS rank FROM m)
SELECT fq.conv_id, fq.turn, COALESCE(n_matches, 0) AS n_matches, rank, product_id, name
FROM fq LEFT JOIN (SELECT * FROM r WHERE rank <= 4) r ON r.conv_id = fq.conv_id AND r.turn = fq.turn""")
def q_find_keywords(spark, d):
    t = tables(spark, d)
    pub = C.catalog_published(t.data_products)
    turns = S.question_turns(t.conversations).select("conv_id", F.col("turn").cast("long").alias("turn"), "text")

    def find(*cols):
        return cols[0], cols[1].cast("long").alias("turn"), F.concat(F.lit("find "), cols[2]).alias("text")

    domain = F.coalesce("domain", F.lit("Other"))
    asked = turns.unionByName(turns.select(*find(F.col("conv_id"), F.col("turn") + 1_000_000_000, F.col("text")))) \
        .unionByName(pub.select(*find(F.col("product_id").alias("conv_id"), F.lit(-1), F.col("display_name")))) \
        .unionByName(pub.groupBy(domain.alias("d")).agg(F.min("product_id").alias("conv_id"))
                     .select(*find(F.col("conv_id"), F.lit(-2), F.col("d"))))
    return S.find_matches(asked, C.normalize_products(pub))


@register("strip_markdown", f"""
SELECT doc_id, {js_trim_sql(
    f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE(text, ''), '\\*\\*(.+?)\\*\\*', '\\1', 'g'), "
    f"'\\*(.+?)\\*', '\\1', 'g'), '(?m)^#+{WS}+', '', 'g'), '(?m)^[*\\-]{WS}+', '• ', 'g')")} AS text FROM documents""")
def q_strip_markdown(spark, d):
    return S.stripped_documents(tables(spark, d).documents)


@register("match_questions", f"""WITH {PUB}, {QUESTIONS},
pw AS (SELECT DISTINCT product_id, unnest({words_sql("concat_ws(' ', display_name, COALESCE(domain, ''), array_to_string(tags, ' '), COALESCE(description, ''))")}) AS word FROM pub),
qw AS (SELECT DISTINCT conv_id, turn, unnest({words_sql('text')}) AS word FROM q),
sc AS (SELECT conv_id, turn, product_id, round(sum(CAST(1.0 AS DOUBLE)), 9) AS score, count(*) AS shared_words
       FROM qw JOIN pw USING (word) GROUP BY conv_id, turn, product_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, product_id) AS rank FROM sc) WHERE rank <= 5""")
def q_match_questions(spark, d):
    t = tables(spark, d)
    return S.match_questions(S.question_turns(t.conversations), C.catalog_published(t.data_products), 5)
