"""URL filter: path rules first, then trust and distrust along the links between hosts.

``RULES`` decide the pages they fit. Of every host, the share of its pages that
rules allow is its seed of trust, the share that they block its seed of
distrust. Trust follows the links (a host vouches for those it links to);
distrust goes back along them (a host answers for those it links to). Both are
personalised PageRanks, written as the sum of walks

    score = seed + DAMPING * P(seed) + DAMPING^2 * P(P(seed)) + ...

where P hands a host's mass to its neighbours in proportion to the number of
links; mass of a host without neighbours ends there. The sum is taken one step
of all walks at a time, until no host gets ``LEAST`` more. Scores so have the
scale of the seeds: a host all of whose pages are blocked has at least 1.

A page that no rule fits is blocked if its host's distrust is over
``THRESHOLD`` and over its trust. Hosts without links are judged by their seeds.

Spark holds one row for each pair of linked hosts, both directions in one
table, and one row for each host with mass on its way; a step is one join and
one sum. A host with a third of all links is split by adaptive skew joins on
the side of its links, and partial sums are taken before each shuffle.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, fresh

#: (host, start of the path, verdict); a rule fits its host and all subdomains.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING = 0.85
THRESHOLD = 0.5
#: Mass under which a walk ends.
LEAST = 1e-4
#: Steps after which what is left of any walk is under ``LEAST`` of its start.
STEPS = 57
#: Host of the absolute links of a page (relative ones stay on their host).
LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'\s>/?#]+)"""


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    Of equally long ones that with the longer host wins, then blocking."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block")):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of one host link to another host."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    found = found.withColumn("dst", lower_ascii(F.col("dst")))
    return found.where("src != dst AND src != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host with some, from ``seeds`` (host, trust, distrust) and ``edges`` (src, dst, n)."""
    both = edges.select(F.lit(0).alias("field"), "src", "dst", "n").unionAll(
        edges.select(F.lit(1), F.col("dst"), F.col("src"), F.col("n")))
    total = both.groupBy("field", "src").agg(F.sum("n").alias("total"))
    steps = cut_lineage(both.join(total, ["field", "src"]).select(
        "field", F.col("src").alias("host"), "dst", (F.lit(damping) * F.col("n") / F.col("total")).alias("share")))
    mass = seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("field"), F.col("trust").alias("mass")),
                                                  F.struct(F.lit(1).alias("field"), F.col("distrust").alias("mass")))).alias("s"))
    way = cut_lineage(mass.select("s.field", "host", "s.mass").where("mass > 0"))
    walked = [way]
    for _ in range(0 if steps.isEmpty() else STEPS):
        moved = way.join(steps, ["field", "host"]).groupBy("field", F.col("dst").alias("host")).agg(
            F.sum(F.col("mass") * F.col("share")).alias("mass"))
        way = cut_lineage(moved)
        if (way.agg(F.max("mass")).first()[0] or 0) < LEAST:
            break
        walked.append(way)
    summed = reduce(DataFrame.unionByName, walked)
    return summed.groupBy("host").agg(*[
        F.coalesce(F.sum(F.when(F.col("field") == k, F.col("mass"))), F.lit(0.0)).alias(name)
        for k, name in enumerate(("trust", "distrust"))])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) to pages (url, html, ...).

    Columns of these names are replaced. A null url, or one without ``://``, has
    an empty host and path; no rule fits it, it has no part in the graph and is
    allowed. Null and empty html has no links. Pages that repeat count as often
    as they stand there. No pages give no rows.
    """
    found, before = fresh(pages, "_found"), fresh(pages, "_host")
    parted = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parted = parted.withColumn(found, rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col(f"{found}.verdict")
    counted = parted.where("host != ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(verdict == "allow").alias("a"), F.count_if(verdict == "block").alias("b"))
    seeds = counted.select("host", (F.col("a") / F.col("n")).alias("trust"), (F.col("b") / F.col("n")).alias("distrust"))
    scored = scores(seeds, cut_lineage(links(parted)))
    bad = scored.where((F.round("distrust", 9) > threshold) & (F.round("distrust", 9) > F.round("trust", 9)))
    bad = broadcast_if_small(cut_lineage(bad.select(F.col("host").alias(before))))
    out = parted.join(bad, F.col("host") == F.col(before), "left")
    judged = F.coalesce(verdict, F.when(F.col(before).isNotNull(), "block").otherwise("allow"))
    return out.withColumns({"rule": F.col(f"{found}.rule"), "verdict": judged}).drop(found, before)
