"""URL verdicts: rules first, then an empirical-Bayes reputation of the host.

A host's share of bad pages is shrunk towards its registered domain's, that one towards its suffix's,
and that towards the share of all labelled pages. How strongly is estimated from the data: at each
level the spread between groups beyond what chance explains gives the weight of the beta prior. A
page is blocked when the lower posterior bound of its host's bad share reaches the limit, so hosts
nobody has judged are not blocked on a hunch.

Only column expressions and aggregates. Pages are counted per host with a partial aggregate, and all
later levels work on host counts; pages meet their host's verdict in a plain equi-join, which
adaptive execution broadcasts or splits when one host has a large share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise

#: Labels that stand before a two-letter country label in common public suffixes.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lowered; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two for names like ``co.uk``."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    country = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(SECOND_LEVEL)
    return F.when(country, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one more label, or the host itself if it has no more."""
    two_labels = F.instr(suffix_of(host), ".") > 0
    return F.when(two_labels, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of ``rules`` = (verdict, host, path) that fits, or nulls.

    A rule fits its host and all subdomains where the path starts with its path; of rules of one
    length, ``block`` wins. Rules are configuration and become one expression.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        value = F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


def _shrunk(groups: DataFrame, mean: str, out: str, bounds: tuple[float, float]) -> DataFrame:
    """Posterior mean ``out`` and prior weight ``weight`` of each group (``n``, ``bad``) around ``mean``.

    The spread between groups is estimated by moments: the squared distances of group shares from
    their prior means, less what binomial noise would give.
    """
    p = F.col("bad") / F.col("n")
    noise = F.col(mean) * (1 - F.col(mean))
    sums = groups.filter("n > 0").agg(
        F.sum(F.col("n") * (p - F.col(mean)) ** 2 - noise).alias("spread"),
        F.sum(F.col("n") * noise).alias("noise"),
        F.sum("n").alias("total"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
    )
    freedom = F.col("total") - F.col("squares") / F.col("total")
    between = F.when(freedom > 0, F.greatest(F.col("spread"), F.lit(0.0)) / freedom)
    share = F.try_divide(between, F.col("noise") / F.col("total"))
    low, high = bounds
    weight = F.when(share > 0, F.least(F.greatest((1 - share) / share, F.lit(low)), F.lit(high))).otherwise(high)
    scalar = sums.select(F.round(weight, 6)).scalar()
    return groups.withColumn("weight", F.coalesce(scalar, F.lit(high))).withColumn(
        out, (F.col("bad") + F.col("weight") * F.col(mean)) / (F.col("n") + F.col("weight"))
    )


def reputation(
    pages: DataFrame, host: str, bad: str, z: float = 1.645, bounds: tuple[float, float] = (1.0, 1000.0)
) -> DataFrame:
    """One row per host: ``n`` labelled pages, ``n_bad``, posterior ``mean`` and ``lower`` bound of the bad share.

    ``bad`` is 1, 0, or null for unlabelled pages. The bound is the posterior mean less ``z``
    posterior standard deviations. Without any label the mean is one half everywhere and the bound
    is low; a null host counts as the empty host; an empty table gives no rows. The counts per host
    are written to the shared folder, so the pages are read once.
    """
    names = pages.select(F.coalesce(host, F.lit("")).alias("host"), F.col(bad).cast("long").alias("bad"))
    counted = names.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialise(
        counted.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"),
        "hosts",
    )
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = hosts.groupBy("suffix").agg(*add)
    overall = hosts.agg(F.round(F.try_divide(F.sum("bad"), F.sum("n")), 9)).scalar()
    top = _shrunk(suffixes.withColumn("all_mean", F.coalesce(overall, F.lit(0.5))), "all_mean", "suffix_mean", bounds)
    middle = _shrunk(domains.join(top.select("suffix", "suffix_mean"), "suffix"), "suffix_mean", "domain_mean", bounds)
    low = _shrunk(hosts.join(middle.select("domain", "suffix", "domain_mean"), ["domain", "suffix"]), "domain_mean", "mean", bounds)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return low.select("host", "n", F.col("bad").alias("n_bad"), "mean", (F.col("mean") - z * deviation).alias("lower"))


def judge(
    pages: DataFrame,
    url: str,
    rules: Sequence[tuple[str, str, str]],
    outcome: Column | None = None,
    limit: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and the host's ``bad_share`` and ``bad_lower``.

    ``outcome`` (1 bad, 0 good, null unlabelled) labels pages; by default the rules do: a page that a
    rule fits is an outcome of its host, which then speaks for the host's other pages. The rule's
    verdict stands where there is one; else ``block`` where the lower bound reaches ``limit``. Rows
    are kept one for one, repeated ones too; null urls and urls without ``://`` have empty host and
    path. Columns of ``pages`` with the names of results are replaced.
    """
    results = ["host", "path", "rule", "verdict", "bad_share", "bad_lower"]
    parts = pages.drop(*results).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ruled = parts.withColumn("_rule", longest_rule(F.col("host"), F.col("path"), rules))
    if outcome is None:
        outcome = F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0)
    known = reputation(ruled.withColumn("_bad", outcome), "host", "_bad", z)
    known = known.select("host", F.col("mean").alias("bad_share"), F.col("lower").alias("bad_lower"))
    own = F.when(F.col("bad_lower") >= limit, "block").otherwise("allow")
    return (
        ruled.join(known, "host")
        .withColumn("rule", F.col("_rule.rule"))
        .withColumn("verdict", F.coalesce(F.col("_rule.verdict"), own))
        .drop("_rule")
    )
