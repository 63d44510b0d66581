"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of
different character n-grams (n = 1 to ``ORDER``, letters lower-cased, all else
one space) that both have, divided by the geometric mean of what each has.
N-grams are numbered by a hash into ``DIM`` features.

Training: kernel ridge regression, one language against the rest, on Nystroem
features: with landmarks Z the kernel is replaced by K_xz K_zz^-1 K_zx, so only
landmark-sized matrices are solved. It learns every language that labelled
rows have, from a bounded sample: ``PER_LANGUAGE`` windows of each, chosen by a
hash of the id (one row for each id); of these, ``LANDMARKS`` for each language are landmarks. Beyond
``LANGUAGES`` languages both shrink, so that all together have no more than
``LANGUAGES`` languages had, but ``LEAST_SAMPLE`` windows and one landmark are
left to each: no language is left out. One regression against the rest needs
of all others only sums that the languages share, so they are solved together
from sums over blocks of windows; the driver holds the landmarks, one block and
matrices of landmarks by landmarks and by languages.

Prediction reads whole texts in windows of ``WINDOW`` characters, since the
presence of n-grams tells nothing about a text that is long enough to have them
all. The windows of a batch are one presence matrix; kernel, Nystroem map and
regression are linear in it, so their product is formed once and scoring is one
matrix product per batch. A text's score is the mean of its windows' by size.

The scores of a text sum to one over the languages, so they say which language
is nearest, not whether any is near. That is told by the share of its letter
triples (space at the ends) that occur in the sample, numbered by a 24-bit hash.
The bound is set for each language on the sample, never on held-out rows:
``PART`` of the share that all but ``LEAST_WORDS`` of its single words reach
when the window they are from is left out.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut_lineage, fresh, ship_package

ORDER = 3
DIM = 1 << 15
WINDOW = 2000
PER_LANGUAGE = 400
LANDMARKS = 120
LANGUAGES = 12
LEAST_SAMPLE = 5
#: Windows made into kernel values at once in training.
ROWS = 2048
RIDGE = 1.0
#: Windows scored at once.
BATCH = 128
UNKNOWN = "und"
#: No bar on the score: the best of scores that sum to one is never under 1 / languages, whatever the text.
LEAST_SCORE = 0.0
TRIPLES = 1 << 24
#: A text is in a learned language from this part of the known share of that language's single words, ...
PART = 0.6
#: ... taken where this share of them has less, over the first ``WORDS`` words of each sampled window.
LEAST_WORDS = 0.01
WORDS = 16


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbols(text: str) -> np.ndarray:
    """Code points of a text in lower case, every run of other characters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others
    return codes[keep].astype(np.uint64)


def features(codes: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of a symbol array, repeats included."""
    out, gram = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, ORDER + 1):
        if len(codes) < n:
            break
        gram = gram[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n)
        mixed = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def pieces(text: str | None) -> list[np.ndarray]:
    """Symbols of each window of a text (no letters: none)."""
    codes = symbols(text or "")
    if not (codes != 32).any():
        return []
    return np.array_split(codes, max(1, round(len(codes) / WINDOW)))


def windows(text: str | None) -> list[np.ndarray]:
    """Feature numbers of each window of a text (no letters: none)."""
    return [features(p) for p in pieces(text)]


def triples(codes: np.ndarray) -> np.ndarray:
    """Numbers of all three-symbol runs, repeats included, with a space before and after the symbols."""
    space = np.full(1, 32, dtype=np.uint64)
    c = np.concatenate((space[:int(codes[0] != 32)], codes, space[:int(codes[-1] != 32)]))
    gram = (c[:-2] * np.uint64(0x100000001B3) + c[1:-1]) * np.uint64(0x100000001B3) + c[2:]
    return (((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64)


def first_words(codes: np.ndarray) -> list[np.ndarray]:
    """Triples of each of the first ``WORDS`` words of a symbol array."""
    words = np.split(codes, np.flatnonzero(codes == 32))
    return [triples(w) for w in (x[x != 32] for x in words) if len(w)][:WORDS]


def presence(rows: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(rows), DIM), dtype=np.float32)
    x[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)] = 1
    return x


@dataclass(frozen=True)
class Model:
    """The product of ``weights`` maps presence rows, divided by the root of their size, to scores of the languages."""

    languages: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    bias: np.ndarray
    #: Triples of the sample, and the least share of them by language (none: every text is in a learned language).
    known: np.ndarray | None = None
    least: np.ndarray | None = None

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        x = presence(rows)
        size = np.sqrt(x.sum(axis=1, keepdims=True))
        for w in self.weights:
            x = x @ w
        return x / size + self.bias


def fit(samples: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Trains on (language, feature numbers) rows."""
    languages = tuple(sorted({lang for lang, _ in samples}))
    if not languages:
        return Model((), (np.zeros((DIM, 0), np.float32),), np.zeros(0, np.float32))
    number = {lang: k for k, lang in enumerate(languages)}
    label = np.array([number[lang] for lang, _ in samples])

    def scaled(at):
        x = presence([samples[i][1] for i in at])
        x /= np.sqrt(x.sum(axis=1, keepdims=True))
        return x

    marks = np.concatenate([np.flatnonzero(label == k)[:landmarks] for k in range(len(languages))])
    z = scaled(marks)
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    m, n = root.shape[1], len(samples)
    square, sums = np.zeros((m, m)), np.zeros((len(languages), m))
    for i in range(0, n, ROWS):
        phi = (scaled(range(i, min(i + ROWS, n))) @ z.T) @ root
        square += phi.T @ phi
        np.add.at(sums, label[i:i + ROWS], phi)
    # Targets are 1 for the own language and -1 else, so their products with phi are sums by language.
    center, middle = sums.sum(axis=0) / n, 2 * np.bincount(label, minlength=len(languages)) / n - 1
    own = square - n * np.outer(center, center)
    w = np.linalg.solve(own + ridge * np.eye(m), (2 * sums - sums.sum(axis=0)).T - n * np.outer(center, middle))
    last = root @ w
    weights = (z.T @ last,) if len(languages) <= len(marks) // 2 else (z.T, last)
    return Model(languages, tuple(x.astype(np.float32) for x in weights), (middle - center @ w).astype(np.float32))


def bounds(languages: tuple[str, ...], samples: list[tuple[str, np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Known triples and the least share by language, from rows (language, a window's different triples, its words')."""
    known, seen = np.unique(np.concatenate([w for _, w, _ in samples]), return_counts=True)
    elsewhere = np.zeros(TRIPLES, dtype=bool)
    elsewhere[known[seen > 1]] = True
    shares = {lang: [] for lang in languages}
    for lang, _, words in samples:
        shares[lang] += [elsewhere[w].mean() for w in words]
    least = [PART * np.quantile(shares[lang], LEAST_WORDS, method="lower") if shares[lang] else 0.0 for lang in languages]
    return known.astype("<u4"), np.array(least)


def held_out(id_col: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 2 modulo 4 (null ids: not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model:
    """Learns every language of the labelled rows that are not held out.

    Rows with a null id, language or text, and those without a letter, teach
    nothing. Rows that repeat an id in a language count once, with one of their
    texts. Without any such row nothing is learned and every text is ``und``.
    Other columns are not looked at."""
    known = df.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                     & ~held_out(F.col(id_col)))
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = cut_lineage(known.select(F.col(lang_col).alias("lang"), order.alias("o")).distinct())
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = counts.count()
    # Beyond ``languages`` they share what that many have.
    share = min(1.0, languages / max(1, found))
    per_language, landmarks = max(LEAST_SAMPLE, int(per_language * share)), max(1, int(LANDMARKS * share))
    # Ids first, by the smallest hashes of each language. Hashes are uniform, so of a language's n about ``ample`` lie
    # under this bound, and the smallest among them; only these come together.
    ample = 4 * per_language + 64
    bound = F.lit(-2.0 ** 63) + F.lit(2.0 ** 64) * (F.lit(float(ample)) / F.col("n"))
    near = broadcast_if_small(counts.select(
        "lang", F.when(F.col("n") > ample, bound).otherwise(F.lit(2.0 ** 63)).alias("last")))
    place = Window.partitionBy("lang").orderBy("o")
    chosen = {(r["lang"], r["o"]) for r in ids.join(near, "lang").where(F.col("o").cast("double") <= F.col("last"))
              .withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_language).collect()}
    if not chosen:
        return fit([])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("o", T.LongType()),
                           T.StructField("grams", T.BinaryType()), T.StructField("triples", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.BinaryType()))])

    def sample(batches):
        for b in batches:
            lang, key, grams, runs, words = [], [], [], [], []
            for name, o, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                parts = pieces(text.as_py()) if (name, o) in chosen else []
                if parts:
                    part = parts[o % len(parts)]
                    lang.append(name)
                    key.append(o)
                    grams.append(np.unique(features(part)).astype("<u4").tobytes())
                    runs.append(np.unique(triples(part)).astype("<u4").tobytes())
                    words.append([w.astype("<u4").tobytes() for w in first_words(part)])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(key, pa.int64()),
                                              pa.array(grams, pa.binary()), pa.array(runs, pa.binary()),
                                              pa.array(words, pa.list_(pa.binary()))], names=schema.names)

    ship_package(df.sparkSession)
    texts = (known.select(F.col(lang_col).alias("lang"), order.alias("o"), F.col(text_col).alias("text"))
             .where(F.col("o").isin([o for _, o in chosen])).groupBy("lang", "o")
             .agg(F.min(F.struct(F.xxhash64("text").alias("t"), "text")).alias("x")).select("lang", "o", "x.text"))
    rows = texts.mapInArrow(sample, schema).collect()  # one window of at most 3 WINDOW numbers for each chosen id
    rows.sort(key=lambda r: (r["lang"], r["o"], bytes(r["grams"])))

    def numbers(b):
        return np.frombuffer(b, dtype="<u4").astype(np.int64)

    model = fit([(r["lang"], numbers(r["grams"])) for r in rows], landmarks)
    if not rows:
        return model
    known, least = bounds(model.languages, [(r["lang"], numbers(r["triples"]), [numbers(w) for w in r["words"]]) for r in rows])
    return replace(model, known=known, least=least)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred",
            score_name: str = "score", learned_name: str | None = None) -> DataFrame:
    """``df`` with the predicted language and its score, 0 to 1 (0.5: the regression's decision bound), and, if
    ``learned_name`` is given, whether the text's share of known triples reaches the predicted language's bound.

    Null texts and those without a letter are ``und`` with score 0, and so is
    every text if nothing could be learned. Columns of these names are replaced;
    every row is predicted for itself, from its text alone.
    """
    keep = [c for c in df.columns if c not in (lang_name, score_name, learned_name)]
    at = df.columns.index(text_col)
    index = [df.columns.index(c) for c in keep]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(lang_name, T.StringType()),
                                                          T.StructField(score_name, T.DoubleType())]
                          + [T.StructField(c, T.BooleanType()) for c in (learned_name,) if c])

    def run(batches):
        known = None
        if learned_name and model.known is not None:
            known = np.zeros(TRIPLES, dtype=bool)
            known[model.known] = True
        for b in batches:
            hits, runs = np.zeros(b.num_rows), np.zeros(b.num_rows)
            total, size = np.zeros((b.num_rows, len(model.languages))), np.zeros(b.num_rows)
            rows, owner = [], []

            def flush():
                n = np.array([len(r) for r in rows], dtype=float)
                np.add.at(total, owner, model.scores(rows) * n[:, None])
                np.add.at(size, owner, n)
                rows.clear()
                owner.clear()

            for i, text in enumerate(b.column(at)):
                for part in pieces(text.as_py()) if model.languages else ():
                    if known is not None:
                        found = known[triples(part)]
                        hits[i] += found.sum()
                        runs[i] += len(found)
                    rows.append(features(part))
                    owner.append(i)
                    if len(rows) == BATCH:
                        flush()
            if rows:
                flush()
            lang, score, learned = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=bool)
            for i in np.flatnonzero(size):
                mean = total[i] / size[i]
                best = int(mean.argmax())
                lang[i], score[i] = model.languages[best], min(1.0, max(0.0, (mean[best] + 1) / 2))
                learned[i] = known is None or hits[i] >= model.least[best] * runs[i]
            made = [pa.array(lang, pa.string()), pa.array(score)] + [pa.array(learned)] * bool(learned_name)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in index] + made, names=schema.names)

    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def keep_known(df: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``df`` in a learned language, with their columns: a text without letters goes, one with too
    few known triples, and one whose best score is under ``least``. Null and empty texts have no letter. Every row is
    judged for itself, also if it repeats; no rows give no rows, and a model that learned nothing keeps none."""
    lang, score, learned = fresh(df, "_lang_pred"), fresh(df, "_lang_score"), fresh(df, "_lang_learned")
    marked = predict(df, model, text_col, lang, score, learned)
    return marked.where((F.col(lang) != UNKNOWN) & F.col(learned) & (F.col(score) >= least)).drop(lang, score, learned)
