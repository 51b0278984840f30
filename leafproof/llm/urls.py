"""URL filters (native): explicit host/path rules, then empirical-Bayes host reputation.

Pages are judged by rules first: the longest fitting rule decides. All others get a verdict from labelled page
outcomes. A host's share of bad pages is shrunk towards its registered domain's, that one towards its suffix's, and
that one towards the share of all pages. Each level is a beta-binomial model whose prior weight is estimated from the
spread of the level's own groups (the analysis-of-variance estimator), so noisy levels lend little and tight ones
much, but never more than the pages they rest on. A host is blocked if the lower posterior bound of its bad share, mean - z * sd of the beta posterior, exceeds
the limit.

Everything is DataFrame expressions. Counts are pre-aggregated before any shuffle, and only per-host rows are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable

#: Two-label suffixes under which names are registered. A fixed, public list, given as a parameter.
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.tr", "com.mx")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """z: posterior standard deviations below the mean; limit: the bad share that bound may not exceed;
    least, most: bounds of an estimated prior weight in pages."""

    z: float = 1.645
    limit: float = 0.25
    least: float = 1.0
    most: float = 1000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: then up to
    '?', '#' or the end. Null, or no '://': both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def domain_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The registered domain: the last two labels, three below a second-level suffix; shorter hosts as they are."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column, second_level: tuple[str, ...] = SECOND_LEVEL) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*second_level), two).otherwise(F.substring_index(host, ".", -1))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal length, the first in the list."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def prior_weight(groups: DataFrame, mean: str, least: float, most: float) -> DataFrame:
    """One row (w): the beta-binomial prior weight of groups with columns n, bad and the parent's mean.

    With pooled variance v = mean (1 - mean) of each parent, the spread ratio is
    rho = (sum n d^2 / v - (K - 1)) / (N - sum n^2 / N - (K - 1)), d the group's deviation from its parent, K groups
    and N pages; w = (1 - rho) / rho, clipped to least..most. No or degenerate groups give most.
    """
    v = F.col(mean) * (1 - F.col(mean))
    d = F.col("bad") / F.col("n") - F.col(mean)
    g = groups.filter((F.col("n") > 0) & (v > 0)).agg(
        F.sum(F.col("n") * d * d / v).alias("s"), F.count("*").alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("t2")
    )
    over = F.col("s") - (F.col("k") - 1)
    room = F.col("t") - F.col("t2") / F.col("t") - (F.col("k") - 1)
    rho = F.when((F.col("t") > 0) & (room > 0), over / room)
    return g.select(F.when(rho > 0, F.least(F.lit(most), F.greatest(F.lit(least), (1 - rho) / rho))).otherwise(F.lit(most)).alias("w"))


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation(), names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """outcomes: rows (host, bad 0/1; null bad: not labelled). names: rows (host), repeated ones included.

    Returns (hosts, whole): hosts has a row for each host with a label: host, n_labelled, n_bad, bad_mean, bad_bound;
    with names, also one for each other host in them whose domain or suffix has a label, with that parent's posterior.
    whole is one row with the bad_mean and bad_bound of all other hosts. No labels at all: 0 and 0.
    """
    hosts = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad")
    hosts = durable(hosts, "host-outcomes")  # every level and every prior is made from these few rows
    domains = durable(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domain-outcomes")
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffix-outcomes")
    whole = suffixes.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("gn"))
    whole = durable(whole, "all-outcomes")

    def shrink(groups: DataFrame) -> DataFrame:
        """groups: n, bad, and the parent's mean m and weight k. The prior weighs no more than the pages it rests on
        elsewhere, k - n. Adds the posterior's mean and weight. Written, so that no level's plan holds another's."""
        groups = durable(groups, "url-level")
        w = F.least(prior_weight(groups, "m", p.least, p.most).scalar(), F.greatest(F.lit(0.0), F.col("k") - F.col("n")))
        return groups.withColumn("w", w).withColumn("mean", (F.col("bad") + F.col("w") * F.col("m")) / (F.col("n") + F.col("w"))).withColumn("weight", F.col("n") + F.col("w"))

    def bound(mean: Column, weight: Column) -> Column:
        return F.greatest(F.lit(0.0), mean - F.lit(p.z) * F.sqrt(mean * (1 - mean) / (weight + 1)))

    up = [F.col("mean").alias("m"), F.col("weight").alias("k")]
    s = durable(shrink(suffixes.select("*", whole.select("g").scalar().alias("m"), whole.select("gn").scalar().alias("k"))).select("suffix", *up), "suffix-posterior")
    d = durable(shrink(domains.join(s, "suffix")).select("domain", *up), "domain-posterior")
    h = shrink(hosts.join(d, "domain"))
    out = h.select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.col("mean").alias("bad_mean"), bound(F.col("mean"), F.col("weight")).alias("bad_bound"))
    if names is not None:
        new = names.select("host").distinct().join(hosts.select("host"), "host", "left_anti").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
        new = new.join(d.select("domain", F.struct("m", "k").alias("d")), "domain", "left").join(s.select("suffix", F.struct("m", "k").alias("s")), "suffix", "left")
        new = new.select("host", F.coalesce("d", "s").alias("up")).filter("up is not null")
        none = F.lit(0).cast("long")
        out = out.unionByName(new.select("host", none.alias("n_labelled"), none.alias("n_bad"), F.col("up.m").alias("bad_mean"), bound(F.col("up.m"), F.col("up.k")).alias("bad_bound")))
    return out, whole.select(F.col("g").alias("g_mean"), bound(F.col("g"), F.lit(p.least)).alias("g_bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], p: Reputation = Reputation()) -> DataFrame:
    """Judge each row of pages (page_id, url) by the rules, else by its host's reputation.

    outcomes: (page_id, bad) with bad 0, 1 or null; several rows of a page all count. Returns page_id, host, path,
    rule, verdict (allow or block), n_labelled, n_bad, bad_mean, bad_bound: a row for each row of pages, repeated rows
    included. Null or unparsable urls have empty host and path and count as one host. A page_id of null has no
    outcome. Empty pages or outcomes are fine: without labels nothing but the rules blocks. Other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").alias("_pid"), F.col("bad").cast("int").alias("bad")).filter("bad is not null")
    seen = split.select("page_id", "host").join(known, F.col("page_id") == F.col("_pid")).select("host", "bad")
    hosts, whole = host_reputation(seen, p, split)
    rule, fixed = best_rule(F.col("host"), F.col("path"), rules)
    bound = F.coalesce(F.col("bad_bound"), F.col("g_bound"))
    learnt = F.when(bound > p.limit, "block").otherwise("allow")
    return (
        split.join(hosts, "host", "left")
        .select("*", whole.select("g_mean").scalar().alias("g_mean"), whole.select("g_bound").scalar().alias("g_bound"))
        .select(
            "page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, learnt).alias("verdict"),
            F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"),
            F.coalesce("bad_mean", "g_mean").alias("bad_mean"), bound.alias("bad_bound"),
        )
    )
