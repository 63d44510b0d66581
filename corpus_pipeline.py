"""Corpus pipeline: documents to a deduplicated, mixed and tokenised training set.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet in the shared folder named by the session and reads it
again as the next stage's ``docs``. All stages but the last return the columns
of ``documents``. Null and empty texts, repeated rows and empty tables are
defined by the operators (see their docstrings); extra columns are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stewardlake.llm import bpe, exact_dedup, langid, mixing, queries, simhash
from stewardlake.llm.common import fresh, read_documents
from stewardlake.session import checkpoint_subdir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: texts without a letter, or like no learned language, go."""
    return langid.keep_known(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` but for ``text``, with token ids (packed), their number, and checksums of ids and decoded bytes.

    A column of ``docs`` that has one of these names stays; the new one then gets an underscore at its end."""
    ranks, pattern = queries.tokenizer_file()
    ids, decoded = (fresh(docs, c) for c in ("ids", "decoded"))
    both = bpe.round_trip(docs, ranks, pattern, ids_col=ids, bytes_col=decoded)
    return both.withColumns({
        fresh(docs, "n_tokens"): bpe.n_tokens(both[ids]), fresh(docs, "ids_sha256"): bpe.sha256_hex(both[ids]),
        fresh(docs, "decoded_sha256"): bpe.sha256_hex(both[decoded])}).drop(decoded)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]

#: The language model and the fingerprints have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    base = checkpoint_subdir(spark, f"corpus_pipeline-{uuid.uuid4().hex}")
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
