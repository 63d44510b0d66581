"""Text and search jobs over the catalog and a question log
(F14-F18, X1, X2). The reference asks an LLM with a prompt of 60 products;
here matching is a distributed word join over all products and prompts of
60 products are built as data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, classify_intent, find_keywords, is_question, prompt_line, strip_markdown
from . import common, topk
from .common import fixed

WORD_RE = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Distinct lower-case words (runs of letters and digits of any script) of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), 0))


def question_turns(conversations: DataFrame) -> DataFrame:
    """User turns of the conversation log as questions."""
    return conversations.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def product_words(products: DataFrame) -> DataFrame:
    """(product_id, word): distinct words of name, domain, tags and description."""
    text = F.concat_ws(" ", F.col("display_name"), F.coalesce("domain", F.lit("")),
                       F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "),
                       F.coalesce("description", F.lit("")))
    return products.select("product_id", F.explode(words(text)).alias("word"))


#: Products of the ask prompt (L6, X2): the limit is that prompt's feature.
CONTEXT_SIZE = 60


#: (word set, product) pairs up to which one join and one sum are cheaper than a search in rounds.
DIRECT_PAIRS = 5_000_000


#: Of these, in one task.
PAIRS_IN_TASK = 250_000


def match_questions(questions: DataFrame, products: DataFrame, k: int = 5, weighting: str = "count",
                    direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """Per question the k best of the given products by shared words.

    ``weighting="count"`` scores the number of distinct shared words; ``"idf"``
    weighs each shared word by its BM25 inverse document frequency over the
    products (nine decimals), clipped at zero (words in half or more of them
    weigh nothing).

    Question words that no product has are dropped first, and questions that
    then have the same words are one word set, scored once. What the word join
    would pair is known from the words' frequencies. Up to ``direct_pairs`` it
    is one join, a partial aggregate per (word set, product) and the top k of
    each set by a WindowGroupLimit (score desc, product id asc); beyond, the
    same rows come from the bounded search of ``topk``, which pairs a set with
    few more products than it returns, however many have its words."""
    tasks = common.tasks_for(products.count(), common.ROWS_IN_TASK)
    pw = product_words(products.repartition(tasks, topk.node("product_id", 0)))
    df = pw.groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("df"))
    if weighting == "idf":
        n = products.select(F.count(F.lit(1)).cast("double")).scalar()
        known = df.withColumn("w", F.round(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), 9).cast(topk.WEIGHT)).filter(F.col("w") > 0)
    else:
        known = df.withColumn("w", F.lit(1).cast(topk.WEIGHT))
    qw = questions.select("conv_id", "turn", F.explode(words(F.col("text"))).alias("word"))
    sets = (qw.join(known.hint("merge"), "word", "inner").groupBy("conv_id", "turn")
            .agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("words"), F.sum("df").alias("pairs"))
            .withColumn("set_id", F.sha2(F.to_json("words"), 256)))
    asked = sets.groupBy("set_id").agg(F.first("words").alias("words"), F.first("pairs").alias("pairs"))
    pairs = int(asked.agg(F.sum("pairs")).first()[0] or 0)
    if pairs > direct_pairs:
        best = topk.top_products(asked.select("set_id", F.inline("words")), topk.Postings(pw), k)
    else:
        tasks = max(tasks, shares := common.tasks_for(pairs, PAIRS_IN_TASK))
        # a word of many products is in every share of them
        shared = asked.select("set_id", F.inline("words")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        held = pw.withColumn("share", F.pmod(F.xxhash64("product_id"), F.lit(shares)).cast("int"))
        paired = held.repartition(tasks, "word", "share").join(
            shared.repartition(tasks, "word", "share").hint("shuffle_hash"), ["word", "share"])
        scored = (paired.repartition(tasks, "set_id", "product_id").groupBy("set_id", "product_id")
                  .agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("shared_words")))
        win = Window.partitionBy("set_id").orderBy(F.desc("score"), F.asc("product_id"))
        best = scored.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)
    return sets.select("conv_id", "turn", "set_id").join(best, "set_id", "inner").select(
        "conv_id", "turn", "product_id", F.col("score").cast("double").alias("score"), "shared_words",
        F.col("rank").cast("long").alias("rank"))


def ask_prompt_table(questions: DataFrame, context: DataFrame) -> DataFrame:
    """One prompt per question: the question and the catalog block built
    from the context products (L6: at most 60 rows, so the block is bounded)
    joined in display-name order. The block is a scalar subquery."""
    lines = context.select("display_name", "product_id", prompt_line(
        "product_ref", "display_name", "domain", "type", "description", "tags").alias("line"))
    block = lines.select(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("display_name", "product_id", "line"))), lambda s: s["line"]), "\n")).scalar()
    prompt = F.concat(
        F.lit('User question: "'), F.col("text"), F.lit('"\n\nCatalog (format: ref | name | domain | type | description | tags):\n'),
        block)
    return questions.select("conv_id", "turn", prompt.alias("prompt"))


def question_flags(questions: DataFrame) -> DataFrame:
    """F15 + F16 over a question log: natural-language flag and intent."""
    return questions.select("conv_id", "turn", is_question("text").alias("is_question"),
                            classify_intent("text").alias("intent"))


FIND_SHOWN = 4


#: Lengths of the pieces of tokens that are indexed: a keyword of up to ``LONGEST`` characters is a piece itself.
SHORTEST, LONGEST = 3, 8


#: Matching products from which a keyword is counted by bitmaps.
HOT = 1000


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(
            F.array().cast("array<string>"))


def pieces(token: Column) -> Column:
    """The different substrings of a token of ``SHORTEST`` to ``LONGEST`` characters."""
    return F.array_distinct(F.flatten(F.array(*[_cut(token, n) for n in range(SHORTEST, LONGEST + 1)])))


def keyword_matches(keywords: DataFrame, norm_products: DataFrame) -> DataFrame:
    """(kw, product_id, name): products whose lower-case name or category contains the keyword.

    A keyword has no white space, so it lies within one token of a name or category. The index holds the pieces of
    each different token (linear in its length). A keyword that is a piece itself needs no check; a longer one looks at
    the tokens that have its rarest piece, and each of these is verified by ``contains``. Sizes of frames made from
    products are not those the planner estimates from the files, so no side is broadcast on an estimate."""
    tokens = F.array_distinct(F.split(F.concat_ws(" ", F.lower("name"), F.lower("category")), f"{WS}+"))
    named = norm_products.select("product_id", "name", F.explode(tokens).alias("token")).filter(F.length("token") >= SHORTEST)
    index = named.select("token").distinct().select("token", F.explode(pieces(F.col("token"))).alias("piece"))
    asked = keywords.select("kw").distinct()
    short = asked.filter(F.length("kw") <= LONGEST).join(index.hint("merge"), F.col("kw") == F.col("piece")).select("kw", "token")
    cuts = F.array_distinct(_cut(F.col("kw"), LONGEST))
    long = asked.filter(F.length("kw") > LONGEST).select("kw", F.explode(cuts).alias("piece"))
    full = index.filter(F.length("piece") == LONGEST)
    sizes = full.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = (long.join(sizes.hint("merge"), "piece").groupBy("kw")
              .agg(F.min(F.struct("n", "piece")).alias("g"), F.count(F.lit(1)).alias("found"))
              .filter(F.col("found") == F.size(cuts)).select("kw", "g.piece"))  # a piece no token has: no match
    within = short.unionByName(rarest.join(full.hint("merge"), "piece").filter(F.col("token").contains(F.col("kw"))).select("kw", "token"))
    return within.join(named.hint("merge"), "token").select("kw", "product_id", "name").distinct()


def find_matches(questions: DataFrame, norm_products: DataFrame, shown: int = FIND_SHOWN, hot: int = HOT) -> DataFrame:
    """for each 'find' question, the number of products whose lower-case
    name or category contains any keyword (stop phrases removed, words over
    2 chars) and the first ``shown`` of them in catalog (name) order.

    * Only keywords that are asked are looked up, each once;
    * the shown products of a question are among the first ``shown`` products
      of each of its keywords, so a per-keyword top-k (a WindowGroupLimit) is
      joined to the questions;
    * the count is exact. Keywords of more than ``hot`` products are folded
      into bitmaps of product ids (one per bucket of 32,768 ids); each different
      set of hot keywords ORs its bitmaps once. The products of the other
      keywords are paired with their questions, and those that also have one of
      the question's hot keywords are left out.
    One output row per shown product, with the question's total count; a
    question without any match has one row with count 0 and no product."""
    q = ["conv_id", "turn"]
    found = fixed(questions.filter(classify_intent("text") == "find").select(*q, F.array_distinct(find_keywords("text")).alias("kws")))
    fq = found.select(*q, F.explode("kws").alias("kw")).filter(F.col("kw") != "").distinct()
    matches = fixed(keyword_matches(fq, norm_products))

    by_name = Window.partitionBy("kw").orderBy("name", "product_id")
    first_per_kw = matches.withColumn("r", F.row_number().over(by_name)).filter(F.col("r") <= shown).drop("r")
    cand = fq.join(first_per_kw.hint("merge"), "kw", "inner").select(*q, "product_id", "name").distinct()
    by_q = Window.partitionBy(*q).orderBy("name", "product_id")
    top = cand.withColumn("rank", F.row_number().over(by_q)).filter(F.col("rank") <= shown) \
        .withColumn("rank", F.col("rank").cast("long"))

    # at most one hot keyword for every ``hot`` matches: few enough to broadcast
    hot_kws = F.broadcast(matches.groupBy("kw").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("kw"))
    wide, slim = matches.join(hot_kws, "kw", "left_semi"), matches.join(hot_kws, "kw", "left_anti")
    bitmaps = wide.groupBy("kw", F.bitmap_bucket_number("product_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("product_id")).alias("bits"))
    asked = fq.join(hot_kws, "kw", "left_semi").groupBy(*q).agg(F.array_sort(F.collect_set("kw")).alias("hot_kws")) \
        .withColumn("set_id", F.sha2(F.to_json("hot_kws"), 256))
    sets = asked.groupBy("set_id").agg(F.first("hot_kws").alias("kws")).select("set_id", F.explode("kws").alias("kw"))
    by_set = (sets.join(bitmaps.hint("merge"), "kw").groupBy("set_id", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
              .groupBy("set_id").agg(F.sum("n").alias("n_hot")))
    n_hot = asked.select(*q, "set_id").join(by_set.hint("merge"), "set_id").select(*q, "n_hot")

    has = wide.groupBy("product_id").agg(F.collect_set("kw").alias("has"))
    pairs = fq.join(slim.hint("merge"), "kw").filter(F.col("product_id").isNotNull()).select(*q, "product_id").distinct()
    both = pairs.join(asked.select(*q, "hot_kws").hint("merge"), q, "left").join(has.hint("merge"), "product_id", "left")
    n_rest = both.filter(~F.coalesce(F.arrays_overlap("hot_kws", "has"), F.lit(False))).groupBy(*q).agg(F.count(F.lit(1)).alias("n_rest"))
    n = F.coalesce("n_hot", F.lit(0).cast("long")) + F.coalesce("n_rest", F.lit(0).cast("long"))
    out = found.select(*q).join(n_hot.hint("merge"), q, "left").join(n_rest.hint("merge"), q, "left").join(top.hint("merge"), q, "left")
    return out.select(*q, n.alias("n_matches"), "rank", "product_id", "name")


def stripped_documents(documents: DataFrame) -> DataFrame:
    """F18 over whole documents."""
    return documents.select("doc_id", strip_markdown("text").alias("text"))

