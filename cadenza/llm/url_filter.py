"""URL filter: rule prefixes first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are shrunk through beta-binomial levels: suffix towards all pages,
registered domain towards its suffix, host towards its domain. The prior strength of each
level comes from the spread of the rates below it (method of moments). A host is blocked when the lower
bound of its posterior good rate falls below a threshold. A host without a labelled page takes the prior of its domain, else that
of its suffix, else that of all pages, under the same bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import col, write_shared


@dataclass(frozen=True)
class Rule:
    """A host and path prefix with its verdict; it fits the host and all its subdomains."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


# Public suffixes of more than one label, those most used, from the Public Suffix List as of 2024.
LONG_SUFFIXES = (
    "ac.at", "co.at", "or.at", "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.co", "com.eg", "com.es", "org.es", "asso.fr", "com.fr", "gouv.fr", "com.gr", "com.hk", "org.hk",
    "co.hu", "ac.id", "co.id", "go.id", "or.id", "ac.il", "co.il", "gov.il", "org.il", "ac.in", "co.in", "gov.in", "net.in", "org.in", "edu.it", "gov.it",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.ke", "co.ke", "ac.kr", "co.kr", "go.kr", "or.kr", "com.mx", "gob.mx", "org.mx", "com.my", "edu.my", "gov.my",
    "com.ng", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "com.pe", "com.ph", "gov.ph", "com.pk", "edu.pk", "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl",
    "com.pt", "com.ro", "com.ru", "org.ru", "com.sa", "com.sg", "edu.sg", "gov.sg", "ac.th", "co.th", "go.th", "or.th", "com.tr", "edu.tr", "gov.tr", "org.tr",
    "com.tw", "edu.tw", "gov.tw", "org.tw", "com.ua", "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.vn", "edu.vn", "gov.vn", "ac.za", "co.za", "gov.za", "org.za",
)
_ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def site_of(host: Column) -> Column:
    """The key of a host's reputation: without user, port and closing dots. The contract's ``host`` keeps all three."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:\d*)?\.*$", "")


def suffix_of(site: Column) -> Column:
    """Public suffix: two labels where ``LONG_SUFFIXES`` holds them, else the last; addresses share the suffix ``address``."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(_ADDRESS), F.lit("address")).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """Registered domain: one label more than the public suffix; an address is its own."""
    two = F.substring_index(site, ".", -2)
    return F.when(site.rlike(_ADDRESS), site).when(two.isin(*LONG_SUFFIXES), F.substring_index(site, ".", -3)).otherwise(two)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``; null fields when none fits."""
    chosen = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _strength(good: Column, n: Column) -> Column:
    """Prior strength of one level by moments: mean*(1-mean)/variance - 1 of the well-observed rates, from 1 to 1000."""
    enough = n >= 5
    mean = F.sum(F.when(enough, good)) / F.sum(F.when(enough, n))
    rate = F.when(enough, good / n)
    # The part of the spread that sampling alone explains is taken off.
    noise = F.avg(F.when(enough, 1.0 / n)) * mean * (1 - mean)
    between = F.var_pop(rate) - noise
    return F.coalesce(F.when(between > 0, F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(1.0)), F.lit(1000.0))), F.lit(1000.0))


def host_reputation(outcomes: DataFrame, z: float = 1.0) -> DataFrame:
    """Posterior good rate of each host from rows ``(host, good)``; a null ``good`` names a host without telling its outcome.

    Output: host, n, mean, bound; bound = mean - z * posterior standard deviation. Rows with a null or empty host are left out;
    without any outcome at all nothing is known and no rows come out. Counts are pre-aggregated by host before any shuffle, so a hot host
    costs one record for each task.
    """
    named = outcomes.where(F.coalesce(F.col("host"), F.lit("")) != "")
    hosts = named.groupBy("host").agg(F.coalesce(F.sum(F.col("good").cast("double")), F.lit(0.0)).alias("good"), F.count("good").cast("double").alias("n"))
    hosts = write_shared(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")

    def level(rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
        return rows.groupBy(key, *keep).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))

    domains = level(hosts, "domain", ["suffix"])
    suffixes = level(domains, "suffix", [])
    total_good, total = F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))
    world = suffixes.agg(((total_good + 1) / (total + 2)).alias("prior"), total.alias("n")).first()

    def shrink(rows: DataFrame, prior: Column) -> DataFrame:
        """Beta parameters of each row under its parent's mean; only the strength, one number, comes to the driver."""
        strength = rows.agg(_strength(F.col("good"), F.col("n")).alias("strength")).first()["strength"]
        return rows.withColumn("a", F.col("good") + strength * prior).withColumn("b", F.col("n") - F.col("good") + strength * (1 - prior))

    suffix_prior = shrink(suffixes, F.lit(world["prior"])).select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
    domain_prior = shrink(domains.join(suffix_prior, "suffix"), F.col("prior")).select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("prior"))
    weight = F.col("a") + F.col("b")
    mean = F.col("a") / weight
    return shrink(hosts.join(domain_prior, "domain"), F.col("prior")).where(F.lit(world["n"]) > 0).select(
        "host", F.col("n").cast("long").alias("n"), mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bound")
    )


def filter_urls(pages: DataFrame, outcomes: DataFrame, threshold: float = 0.5, z: float = 1.0, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict, bound.

    ``outcomes`` are those of ``page_outcomes``, which names every page's host. Null urls and urls without ``://`` have empty host and
    path; they have no bound and are allowed, as is every page while no outcome is known. Extra columns are ignored and repeated
    rows kept; an empty table gives no rows.
    """
    url = col("url")
    judged = pages.select(col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("_match", match_rule(F.col("host"), F.col("path"), rules))
    # A left join on the host: the page side may be hot, the other side has one row a host, so AQE can split it.
    sites = host_reputation(outcomes, z).select(F.col("host").alias("_site"), "bound")
    joined = judged.join(sites, site_of(F.col("host")) == F.col("_site"), "left")
    own = F.when(F.col("bound") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path", F.col("_match")["rule"].alias("rule"),
        F.coalesce(F.col("_match")["verdict"], own).alias("verdict"), F.round("bound", 6).alias("bound"),
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, good)`` of every page: a page shows the document whose number ends its path; good is null without a label.

    The host is the key of its reputation (``site_of``). Good: quality 1 and not toxic. A document labelled more than once counts
    once, as its worst label.
    """
    url = col("url")
    shown = F.regexp_extract(path_of(url), r"/(\d{1,18})(?:\.html)?/?$", 1)
    seen = pages.select(site_of(host_of(url)).alias("host"), F.when(shown != "", shown.cast("long")).alias("doc_id"))
    good = F.least(F.min(F.coalesce(col("quality"), F.lit(1))), 1 - F.max(F.coalesce(col("toxic"), F.lit(0))))
    worst = labels.groupBy(col("doc_id")).agg(good.alias("good"))
    return seen.join(worst, "doc_id", "left").select("host", "good")
