"""Secret scans: fixed patterns and a randomness test battery [DataFrame operations only].

Patterns: assignments of passwords and keys, access keys, long hex runs.

Battery: every run of at least ``MIN_RUN`` letters, digits and ``+ / - _`` is a
candidate. Its encoding is inferred from its characters (hex, base 26, 32,
36, 62 or 64) and its symbols go through three tests, each of the hypothesis "written
like language" against "drawn at random":

* chi-squared uniformity of the alphabet: language uses few symbols often, so
  its statistic is far above that of random symbols;
* runs: language changes between small letters, capitals, digits and signs
  seldom, random symbols often (Chernoff bound of the number of changes);
* lag-1 serial correlation of the symbol numbers (Fisher's z): neighbours are
  of one class in language, independent at random.

At least two tests must agree: the candidate's p-value is twice the second
smallest of the three (partial conjunction). A candidate whose uniformity or
correlation no random string would have gets 1. False discoveries are held at
``FDR`` by the Benjamini-Hochberg rule over all candidates of the table,
separately in each length class, since short strings are many and prove
little. Its thresholds come from counts of p-values by class and size (a few
hundred rows whatever the input), so no ranking of candidates is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut_lineage, text_or_empty

#: Fixed patterns; a match of a kind counts if its measured part has the least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_RUN
FDR = 0.01
#: Length classes of the false-discovery control (least lengths).
CLASSES = (20, 32, 64, 128)
#: Symbols in the order of their numbers.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: Language: chance that two letters are equal, class changes for each step, correlation of neighbours.
REPEAT = 0.07
CHANGE = 0.12
SERIAL = 0.3
#: Random strings stay within this many standard deviations.
SIGMAS = 4.5
#: Matches of a text placed at a time.
PLACED = 512
#: Steps of -log10(p) in the counts, and their number.
STEP, STEPS = 0.05, 1200


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found) of a pattern's leftmost non-overlapping matches, in code points.

    Matches and the pieces between them alternate, so a match starts where all
    pieces and matches before it end. Appending copies an array, so matches are
    placed ``PLACED`` at a time: a text with very many costs little more for each.
    """
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def place(found, between):
        def step(acc, i):
            start = acc["at"] + F.char_length(F.element_at(between, i))
            end = start + F.char_length(F.element_at(found, i))
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(
                start.alias("start"), end.alias("end"), F.element_at(found, i).alias("found"))).alias("out"))

        def some(acc, first):
            last = F.least(F.size(found), first + (PLACED - 1))
            placed = F.aggregate(F.sequence(first, last), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return bound(placed, lambda p: F.struct(p["at"].alias("at"), F.array_append(acc["out"], p["out"]).alias("out")))

        zero = F.struct(F.lit(0).alias("at"),
                        F.array().cast("array<array<struct<start:int,end:int,found:string>>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(PLACED)), zero, some, lambda acc: F.flatten(acc["out"]))

    def matches(m):
        return F.when(F.size(m) > 0, bound(F.split(text, pattern, -1), lambda between: place(m, between))).otherwise(none)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), matches)


def normal_tail(z: Column) -> Column:
    """P(Z <= z) of the standard normal (Abramowitz and Stegun 26.2.17 below 0; at most 1e-300 off to 0)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


def alphabet_size(found: Column) -> Column:
    """Symbols of the encoding inferred from a string's characters."""
    return (F.when(found.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16)
            .when(found.rlike("^([a-z]+|[A-Z]+)$"), 26)
            .when(found.rlike("^[A-Z2-7]+$"), 32)
            .when(found.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36)
            .when(found.rlike("^[A-Za-z0-9]+$"), 62)
            .otherwise(64))


def p_value(found: Column) -> Column:
    """The battery's p-value of one candidate, 1 if it is like language or like neither."""
    chars = F.split(found, "")
    codes = F.transform(chars, lambda c: F.instr(F.lit(SYMBOLS), c).cast("double"))
    kinds = F.transform(codes, lambda c: F.when(c <= 26, 1).when(c <= 52, 2).when(c <= 62, 3).otherwise(4))

    def neighbours(values, measure):
        """Sum of a measure over neighbouring values."""
        last = F.size(values) - 1
        return F.aggregate(F.zip_with(F.slice(values, 1, last), F.slice(values, 2, last), measure), F.lit(0.0),
                           lambda a, b: a + b)

    def uniformity(x):
        squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(
            F.char_length(found) - F.char_length(F.replace(found, c, F.lit(""))), F.lit(2.0)))
        return x["k"] * squares / x["n"] - x["n"]

    def moments(x):
        mean = F.aggregate(x["codes"], F.lit(0.0), lambda a, b: a + b) / x["n"]
        return bound(mean, lambda m: F.struct(
            F.aggregate(x["codes"], F.lit(0.0), lambda a, b: a + (b - m) * (b - m)).alias("var"),
            neighbours(x["codes"], lambda a, b: (a - m) * (b - m)).alias("lag")))

    def combined(y):
        n, k, chi = y["n"], y["k"], y["chi"]
        shift = n * (k * F.greatest(F.lit(REPEAT), 2.2 / k) - 1)
        uniform = normal_tail((chi - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift)))
        q = y["changes"] / (n - 1)
        part = F.when(q > 0, q * F.log(q / CHANGE)).otherwise(0.0)
        rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - CHANGE))).otherwise(0.0)
        runs = F.when(q > CHANGE, F.exp(-(n - 1) * (part + rest))).otherwise(1.0)
        r = F.when(y["m"]["var"] > 0, F.greatest(F.lit(-0.999), F.least(F.lit(0.999), y["m"]["lag"] / y["m"]["var"]))
                   ).otherwise(0.999)
        serial = normal_tail((F.atanh(r) - F.atanh(F.lit(SERIAL))) * F.sqrt(n - 3))
        drawn = (F.abs(chi - (k - 1)) / F.sqrt(2 * (k - 1)) < SIGMAS) & (F.abs(r + 1 / n) * F.sqrt(n) < SIGMAS)
        second = F.element_at(F.array_sort(F.array(uniform, runs, serial)), 2)
        return F.when(drawn, F.least(F.lit(1.0), 2 * second)).otherwise(1.0)

    def battery(x):
        return bound(F.struct(
            x["n"].alias("n"), x["k"].alias("k"), uniformity(x).alias("chi"), moments(x).alias("m"),
            neighbours(x["kinds"], lambda a, b: (a != b).cast("double")).alias("changes")), combined)

    return bound(F.struct(chars.alias("chars"), codes.alias("codes"), kinds.alias("kinds"),
                          F.char_length(found).cast("double").alias("n"), alphabet_size(found).cast("double").alias("k")),
                 battery)


def size_of(p: Column) -> Column:
    """-log10(p) in whole steps, rounded down (so a p-value is never taken for a smaller one)."""
    return F.least(F.lit(STEPS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / STEP)).cast("int")


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(CLASSES[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def thresholds(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """Least step that is a discovery, by class, from rows (class, step, candidates): Benjamini-Hochberg."""
    out = {}
    for cls in {c for c, _, _ in counts}:
        own = sorted(((s, n) for c, s, n in counts if c == cls), reverse=True)
        total, rank = sum(n for _, n in own), 0
        for step, n in own:
            rank += n
            if 10 ** (-step * STEP) * total <= fdr * rank and step > 0:
                out[cls] = step
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of ``df``: (doc_id, spans), spans being an array of
    (start, kind, end, found) by start, then kind (0 to 3 as in ``KINDS``).

    Positions are code points, ends exclusive. All runs are tested,
    also where a pattern matches: such a run is reported under both kinds, as
    the battery confirms the match. Null and empty
    texts have no spans; rows that repeat an id are scanned one by one. An empty
    table gives no rows; other columns are not looked at.
    """
    text = text_or_empty(F.col(text_col))
    assign = F.filter(spans(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["found"], ASSIGN, 1)) >= ASSIGN_LEAST)
    table = df.select(F.col(id_col).alias("doc_id"), assign.alias("s0"), spans(text, ACCESS).alias("s1"),
                      spans(text, HEX).alias("s2"), spans(text, RUN).alias("s3"))
    def of_kind(k):
        return F.transform(f"s{k}", lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"),
                                                       s["end"].alias("end"), s["found"].alias("found")))

    base = F.concat(*[of_kind(k) for k in range(3)])
    table = table.select("doc_id", base.alias("base"), "s3")
    tested = F.transform("s3", lambda s: F.struct(
        s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"), s["found"].alias("found"),
        size_of(p_value(s["found"])).alias("step"), length_class(F.char_length(s["found"])).alias("cls")))
    table = cut_lineage(table.select("doc_id", "base", tested.alias("tested")))
    counts = (table.select(F.explode("tested").alias("t")).groupBy("t.cls", "t.step").agg(F.count(F.lit(1)).alias("n"))
              .collect())  # at most classes x steps rows
    least = thresholds([tuple(r) for r in counts], fdr)
    def found(t):
        out = F.lit(False)
        for cls, step in sorted(least.items()):
            out = out | ((t["cls"] == cls) & (t["step"] >= step))
        return out

    random = F.transform(F.filter("tested", found), lambda t: F.struct(
        t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end"), t["found"].alias("found")))
    return table.select("doc_id", F.array_sort(F.concat("base", random)).alias("spans"))


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
