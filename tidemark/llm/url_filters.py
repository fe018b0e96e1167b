"""URL filters: fixed host and path rules, and empirical-Bayes reputation of hosts for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str  # host, then a path that begins with a slash

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: Rules of the registered query (fixed values).
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host runs from the first :// to /, ?, # or the end, with A-Z lower-cased; the path from there
    to ?, # or the end. Null or no ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits the host or a parent of it and begins the path; else nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern = F.when(fits, rule.pattern).otherwise(pattern)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return pattern, verdict


def _strength(stats: DataFrame, parent: str, low: float, high: float) -> DataFrame:
    """(parent, mean, strength) of the beta prior that a parent's children suggest, by the method of moments.

    The spread of the children's rates beyond binomial noise gives the strength, held between low and high; no excess
    spread gives high."""
    of = stats.groupBy(parent).agg(
        F.sum("bad").alias("bad"), F.sum("seen").alias("seen"), F.count("*").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("seen")).alias("squares"),
        F.sum(F.col("seen") * F.col("seen")).alias("seen2"),
    )
    rate = F.col("bad") / F.col("seen")
    noise = rate * (1 - rate)
    # sum of seen * (rate_i - rate)^2 = squares - seen * rate^2; its expectation under noise alone is (k - 1) * noise
    excess = (F.col("squares") - F.col("seen") * rate * rate) - (F.col("k") - 1) * noise
    per_seen = excess / F.greatest(F.col("seen") - F.col("seen2") / F.col("seen"), F.lit(1e-9))
    strength = F.when((excess > 0) & (noise > 0), noise / per_seen - 1).otherwise(F.lit(high))
    return of.select(parent, rate.alias("rate"), "seen", "k", F.least(F.greatest(strength, F.lit(low)), F.lit(high)).alias("strength"))


def host_reputation(pages: DataFrame, labels: DataFrame, low: float = 5.0, high: float = 200.0, z: float = 1.645) -> DataFrame:
    """(host, bad_rate, bad_low): the posterior mean share of bad pages of each host of pages and its lower bound.

    pages: (page_id, host); labels: (page_id, bad boolean), of which repeats are averaged. A suffix (the last label) is
    drawn towards all pages' rate, a registered domain (the last two labels) towards its suffix, a host towards its
    domain. The bound lies z standard deviations below the mean, as of a normal distribution. A host without labelled pages has the prior of its
    domain; where the domain has none either, that of its suffix, and else that of all pages; where only one child has
    labels, at the least strength. Without any labels, no rows."""
    every = pages.where("host <> ''").select("host").distinct()
    marked = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.avg(F.col("bad").cast("double")).alias("bad"))
    hosts = pages.where("host <> ''").join(marked, "page_id").groupBy("host").agg(F.sum("bad").alias("bad"), F.count("*").alias("seen"))
    parents = {"domain": F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0), "suffix": F.regexp_extract("host", r"[^.]*$", 0)}
    hosts = materialise(hosts.withColumns(parents), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).withColumn("root", F.lit(0)), "suffixes")

    def prior(level: DataFrame, parent: str, means: DataFrame) -> DataFrame:
        """(parent, strength, k, prior_mean) of a parent's k children: the mean is the parent's posterior mean."""
        return materialise(_strength(level, parent, low, high).select(parent, "strength", "k").join(means, parent), "prior")

    def shrunk(level: DataFrame, parent: str, given: DataFrame) -> DataFrame:
        """level with alpha and beta of its posterior, and its mean."""
        return (
            level.join(given, parent)
            .withColumn("alpha", F.col("bad") + F.col("strength") * F.col("prior_mean"))
            .withColumn("beta", F.col("seen") - F.col("bad") + F.col("strength") * (1 - F.col("prior_mean")))
            .withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
            .drop("strength", "k", "prior_mean")
        )

    # a half page of each kind keeps the root's mean inside (0, 1)
    root = suffixes.groupBy("root").agg(((F.sum("bad") + 0.5) / (F.sum("seen") + 1)).alias("prior_mean"))
    of_root = prior(suffixes, "root", root)
    of_suffix = materialise(shrunk(suffixes, "root", of_root), "suffix_rates").select("suffix", F.col("mean").alias("prior_mean"))
    in_suffix = prior(domains, "suffix", of_suffix)
    of_domain = materialise(shrunk(domains, "suffix", in_suffix), "domain_rates").select("domain", F.col("mean").alias("prior_mean"))
    in_domain = prior(hosts, "domain", of_domain)

    def named(given: DataFrame, parent: str) -> DataFrame:
        # one child says nothing of how far others spread
        strength = F.when(F.col("k") > 1, F.col("strength")).otherwise(F.lit(low)).alias("strength")
        return given.select(parent, F.struct(strength, "prior_mean").alias(f"of_{parent}"))

    unseen = every.join(hosts, "host", "left_anti").withColumns(parents).withColumn("root", F.lit(0))
    for given, parent in ((in_domain, "domain"), (in_suffix, "suffix"), (of_root, "root")):
        unseen = unseen.join(named(given, parent), parent, "left")
    unseen = unseen.select("host", F.coalesce("of_domain", "of_suffix", "of_root").alias("p")).where("p is not null")
    unseen = unseen.select("host", (F.col("p.strength") * F.col("p.prior_mean")).alias("alpha"), (F.col("p.strength") * (1 - F.col("p.prior_mean"))).alias("beta"))
    seen = shrunk(hosts, "domain", in_domain).select("host", "alpha", "beta")
    a, b = F.col("alpha"), F.col("beta")
    mean, spread = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return seen.unionByName(unseen).select("host", mean.alias("bad_rate"), F.greatest(F.lit(0.0), mean - z * spread).alias("bad_low"))


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    threshold: float = 0.4,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, bad_low) of every row's url.

    labels: (id, bad boolean). The longest fitting rule decides; where none fits, block if the lower posterior bound of
    the host's share of bad pages is above threshold, else allow (also for urls without a host, and for all if there are no
    labels). Hosts without labelled pages have the bound of their domain's prior, else their suffix's or all pages'.
    Repeated rows stay; labels may be empty or hold nulls; other columns are ignored; an empty table gives no rows."""
    host, path = url_parts(F.col(url_col))
    parted = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = labels.select(F.col(id_col).alias("page_id"), F.col("bad"))
    reputation = materialise(host_reputation(parted, seen), "reputation")
    pattern, verdict = match_rules(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bad_low") > threshold, "block").otherwise("allow")
    return (
        parted.join(reputation, "host", "left")
        .select("page_id", "host", "path", pattern.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), "bad_low")
        .withColumnRenamed("page_id", id_col)
    )
