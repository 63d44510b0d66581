"""Queries over the ``documents`` table, one for each operator, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, langid, licenses, merkle, mixing, negatives, quality, secrets, sharding, simhash, urls
from .common import read_documents

N_SHARDS = 16


def tokenizer_file(path: str | None = None) -> tuple[bytes, str]:
    """Rank file content and split pattern; the path defaults to the multilingual vocabulary."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame, *more: str) -> DataFrame:
    ranks, pattern = tokenizer_file()
    both = bpe.decode(bpe.encode(docs.select("doc_id", "text", *more), ranks, pattern).drop("text"), ranks, pattern)
    return both.select("doc_id", *more, bpe.n_tokens(F.col("ids")).alias("n_tokens"),
                       bpe.sha256_hex(F.col("ids")).alias("ids_sha256"),
                       bpe.sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"), count(3).alias("n_random"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = langid.train(docs)
    marked = langid.predict(docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out")), model)
    return marked.select("doc_id", "held_out", "lang_pred", "score")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read_documents(spark, sf_dir)).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_documents(spark, sf_dir)).select(
        "doc_id", "license", "containment", "first_word", "n_words")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fingerprint.edits(read_documents(spark, sf_dir))
    own, changed, following = (fingerprint.pair(c) for c in ("own", "changed", "next_own"))
    return e.select("doc_id", F.char_length("text").cast("long").alias("n_chars"),
                    F.sha2("edited", 256).alias("edited_sha256"),
                    fingerprint.as_text(F.col("own")).alias("fingerprint"),
                    fingerprint.as_text(F.col("changed")).alias("edited_fingerprint"),
                    fingerprint.likeness(own, changed).alias("near_edited"),
                    fingerprint.likeness(own, following).alias("near_next"),
                    fingerprint.resemblance(own, changed).alias("jaccard_edited"), "next_id")


def op10_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(read_documents(spark, sf_dir), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf(*columns, F.col("text")).alias("leaf"),
                         F.when(chosen, merkle.leaf(*columns, lower)).alias("tampered"))
    found = merkle.manifest(leaves, "lang", ["doc_id"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("witness"))
    return (found.withColumn("folded_root", folded)
            .select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("witness"))).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_byte_bpe, op2_secret_scan, op3_language_id, op4_simhash_dedup, op5_source_mix, op6_quality, op7_license_scan,
        op8_exact_dedup,
        op9_fingerprints, op10_hash_ring, op11_url_filter, op12_merkle_manifest,
        op13_hard_negatives)}


#: The unsigned CRC-32 of doc_id in decimal digits (DuckDB has no such function): eight shifts for each byte.
CRC32 = """xor(list_reduce(
  list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""

SQL = {
    "op5_source_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5('mix|' || coalesce(cast(doc_id AS varchar), 'null')) AS turn,
         left(md5(coalesce(text, '')), 16) AS mark,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS srank
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(srank - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM s),
l AS (
  SELECT *, row_number() OVER f AS pos,
    ((SELECT sum(source_size) FROM w) * 1.5::double - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW f AS (ORDER BY source_size / weight, srank)),
c AS (SELECT pos, level FROM l WHERE NOT (most <= level * weight) ORDER BY pos LIMIT 1),
t AS (
  SELECT l.source, l.srank, l.source_size,
    CASE WHEN c.pos IS NULL OR l.pos < c.pos THEN l.most::double ELSE c.level * l.weight END AS target
  FROM l LEFT JOIN c ON true),
q AS (
  SELECT d.*, t.srank, t.source_size, t.target,
    sum(size) OVER (PARTITION BY t.srank ORDER BY turn, doc_id, size, mark ROWS UNBOUNDED PRECEDING) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (served + source_size * copy) / target AS finish FROM q, (VALUES (0), (1)) v(copy) WHERE target > 0),
u AS (
  SELECT *, sum(size) OVER (ORDER BY finish, srank, turn, doc_id, size, mark, copy ROWS UNBOUNDED PRECEDING) AS used FROM k),
m AS (SELECT turn, doc_id, srank, size, mark, cast(count(*) AS bigint) AS copies FROM u
      WHERE used <= 1.5::double * (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, cast(q.size * coalesce(m.copies, 0) AS bigint) AS taken
FROM q LEFT JOIN m ON q.turn = m.turn AND q.doc_id IS NOT DISTINCT FROM m.doc_id AND q.srank = m.srank AND q.size = m.size AND q.mark = m.mark
""",
    "op8_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
""",
}


SQL["op11_url_filter"] = r"""
WITH RECURSIVE rules AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')) v(name, start, verdict)),
u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
d AS (
  SELECT *, (SELECT max({'size': length(name || start), 'name': name, 'rule': name || start, 'verdict': verdict}) FROM rules
             WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS won
  FROM p),
s AS (
  SELECT host, count(*) FILTER (won.verdict = 'allow') / count(*) AS trust,
    count(*) FILTER (won.verdict = 'block') / count(*) AS distrust
  FROM d WHERE host != '' GROUP BY host),
l AS (
  SELECT host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?\bhref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"''\s>/?#]+)', 1)) AS dst
        FROM p)),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src != dst AND src != '' GROUP BY src, dst),
b AS (SELECT 0 AS field, src, dst, n FROM e UNION ALL SELECT 1, dst, src, n FROM e),
w AS (SELECT field, src, dst, 0.85::double * n / sum(n) OVER (PARTITION BY field, src) AS share FROM b),
y AS (
  SELECT * FROM (SELECT 0 AS step, 0 AS field, host, trust AS mass FROM s UNION ALL SELECT 0, 1, host, distrust FROM s)
  WHERE mass > 0
  UNION ALL
  SELECT y.step + 1, y.field, w.dst, sum(y.mass * w.share) FROM y JOIN w ON w.field = y.field AND w.src = y.host
  WHERE y.step < 57 GROUP BY y.step, y.field, w.dst),
x AS (
  SELECT host, coalesce(sum(mass) FILTER (field = 0), 0) AS trust, coalesce(sum(mass) FILTER (field = 1), 0) AS distrust
  FROM y GROUP BY host)
SELECT page_id, d.host, path, won.rule AS rule,
  coalesce(won.verdict, CASE WHEN round(distrust, 9) > 0.5 AND round(distrust, 9) > round(trust, 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM d LEFT JOIN x ON x.host = d.host
"""

SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, text, concat(
    coalesce(strlen(cast(doc_id AS varchar)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(cast(n_chars AS varchar)) || ':' || n_chars, '-')) AS head
  FROM documents),
e AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM d),
f AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n
  FROM e),
t AS (
  SELECT 0 AS level, lang, pos, n, leaf AS node FROM f
  UNION ALL
  SELECT level + 1, lang, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM t WHERE n > 1 GROUP BY level, lang, pos // 8),
s AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM u WHERE n > 1 GROUP BY level, pos // 8),
w AS (
  SELECT level, lang, pos,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM t WHERE n > 1 WINDOW run AS (PARTITION BY level, lang, pos // 8 ORDER BY pos)),
x AS (
  SELECT level, pos,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM u WHERE n > 1 WINDOW run AS (PARTITION BY level, pos // 8 ORDER BY pos)),
y AS (
  SELECT s.lang, list(x.before || ':' || x.after ORDER BY x.level) AS steps
  FROM s JOIN x ON x.pos = s.pos // cast(8 ** x.level AS bigint) GROUP BY s.lang),
z AS (
  SELECT f.lang, f.pos, list(w.before || ':' || w.after ORDER BY w.level) AS steps
  FROM f JOIN w ON w.lang IS NOT DISTINCT FROM f.lang AND w.pos = f.pos // cast(8 ** w.level AS bigint)
  GROUP BY f.lang, f.pos),
p AS (
  SELECT f.doc_id, f.leaf, s.subroot, (SELECT node FROM u WHERE n = 1) AS root,
    list_concat(coalesce(z.steps, []), coalesce(y.steps, [])) AS steps,
    crc.chosen, f.lowered
  FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang
    LEFT JOIN y ON y.lang IS NOT DISTINCT FROM f.lang
    LEFT JOIN z ON z.lang IS NOT DISTINCT FROM f.lang AND z.pos = f.pos
    LEFT JOIN (SELECT DISTINCT doc_id, {crc32} % 3 = 0 AS chosen FROM documents) crc ON crc.doc_id = f.doc_id),
r AS (
  SELECT *, list_reduce(list_prepend(CASE WHEN chosen THEN lowered ELSE leaf END, steps),
    lambda node, step: sha256(split_part(step, ':', 1) || node || split_part(step, ':', 2))) AS folded_root
  FROM p)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), ':', '')) AS proof_sha256, folded_root,
  folded_root = root AS verified
FROM r
""".replace("{crc32}", CRC32)


SQL["op13_hard_negatives"] = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, cast(list_inner_product(a.q, r.q) AS bigint) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id != r.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, cast(row_number() OVER w AS integer) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
