"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Token ids are held packed, as little-endian unsigned 32-bit integers in a
binary column: the compact form in which token shards are stored, and one whose
length and checksum plain SQL functions can take. ``unpack`` gives an array.

Texts go through Arrow batches; one encoder is built per Python worker. A text
longer than ``PIECE`` characters is cut at safe boundaries and encoded piece by
piece, so the encoder's working memory does not grow with the text. A boundary
is safe where no match of the split pattern can reach across it and none looks
ahead past it: between a character that is not white space and white space, or
between ASCII letters, digits and other signs. A stretch without any is encoded
whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship_package

#: Characters that a long text's pieces have at least before the next safe boundary.
PIECE = 1 << 16
#: Code points with the Unicode property White_Space, as in the split pattern's \s (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
SAFE = (rf"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
        r"|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")


@functools.lru_cache(maxsize=4)
def encoder(ranks_file: bytes, pattern: str):
    """The tiktoken encoding of a rank file's content, once per Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
    return tiktoken.Encoding(hashlib.sha256(ranks_file).hexdigest(), pat_str=pattern, mergeable_ranks=ranks,
                             special_tokens={})


@functools.lru_cache(maxsize=1)
def _safe():
    import re

    return re.compile(SAFE)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Consecutive pieces of a text, cut at safe boundaries at least ``size`` apart."""
    start, rx = 0, _safe()
    while len(text) - start > size:
        m = rx.search(text, start + size)
        if not m:
            break
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def _encode(enc, text: str | None) -> bytes:
    if not text:
        return b""
    return b"".join(np.array(enc.encode_ordinary(p), dtype="<u4").tobytes() for p in pieces(text))


def _decode(enc, ids: bytes | None) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids or b"", dtype="<u4").tolist())


def _with_binary(df: DataFrame, column: str, names: list[str], fn, without: tuple[str, ...] = ()) -> DataFrame:
    """Adds (or replaces) binary columns made from another by an Arrow function, which gives a value for each of ``names``.

    A small slice of rows is worked at a time, so a worker holds the results of
    few long texts at once. Columns ``without`` are not sent back.
    """
    at = df.columns.index(column)
    rest = [i for i, c in enumerate(df.columns) if c not in names and c not in without]
    schema = T.StructType([df.schema[i] for i in rest] + [T.StructField(n, T.BinaryType()) for n in names])

    def run(batches):
        for whole in batches:
            for b in _slices(whole, at):
                made = [fn(v) for v in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in rest] + [pa.array([m[k] for m in made], type=pa.binary()) for k in range(len(names))],
                    names=[b.schema.field(i).name for i in rest] + names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def _slices(batch, at: int, limit: int = 8 << 20):
    """Parts of a batch with about ``limit`` bytes in the given column (a longer single value stays whole)."""
    sizes = np.array(pc.binary_length(batch.column(at)).fill_null(0), dtype=np.int64)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(df: DataFrame, ranks_file: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the packed token ids of each text (null: none, as for an empty text).

    ``ranks_file`` is the content of a tiktoken rank file (a vocabulary, fixed
    in size). Every row gives one row; a column that has the name ``ids_col``
    already is replaced. No special tokens: their strings are ordinary text.
    """
    return _with_binary(df, text_col, [ids_col], lambda t: (_encode(encoder(ranks_file, pattern), t),))


def decode(df: DataFrame, ranks_file: bytes, pattern: str, ids_col: str = "ids",
           bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of packed token ids: raw bytes, since ids can end inside a character (null ids: none)."""
    return _with_binary(df, ids_col, [bytes_col], lambda v: (_decode(encoder(ranks_file, pattern), v),))


def round_trip(df: DataFrame, ranks_file: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids",
               bytes_col: str = "decoded") -> DataFrame:
    """``decode(encode(df).drop(text_col))`` in one pass, so that a task has one Python worker and not two."""
    def both(t):
        enc = encoder(ranks_file, pattern)
        ids = _encode(enc, t)
        return ids, _decode(enc, ids)

    return _with_binary(df, text_col, [ids_col, bytes_col], both, without=(text_col,))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of numbers."""
    def number(i):
        part = F.hex(F.substring(ids, i * 4 + 1, F.lit(4)))
        return F.conv(F.concat(*[F.substring(part, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")

    return F.when(F.octet_length(ids) > 0, F.transform(F.sequence(F.lit(0), n_tokens(ids).cast("int") - 1), number)
                  ).otherwise(F.array().cast("array<bigint>"))
