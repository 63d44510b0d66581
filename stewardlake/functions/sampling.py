"""Reproducible pseudo-random fractions for sample generators and backfills.

A fraction is the first 48 bits of the MD5 of key, seed and salt, so it does not
repeat with the key, and any SQL engine with MD5 computes the same fraction:
reruns, recomputed partitions and the SQL oracle all agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 48


def stable_unit(key: Column, seed: int, salt: int) -> Column:
    """A fraction in [0, 1) from an integer key, seed and salt: the first 48 bits of their MD5."""
    text = F.concat_ws("|", key.cast("long").cast("string"), F.lit(str(seed)), F.lit(str(salt)))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long") / float(1 << BITS)


def stable_unit_sql(key: str, seed: int, salt: int) -> str:
    """The same fraction as SQL text (for the oracle)."""
    text = f"CAST(CAST({key} AS BIGINT) AS VARCHAR) || '|{seed}|{salt}'"
    return f"(CAST('0x' || substr(md5({text}), 1, {BITS // 4}) AS BIGINT) / {float(1 << BITS)!r})"
