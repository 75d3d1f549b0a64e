"""URL filtering by rules and by Empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Counts roll up to registered domain
and public suffix; each level's rate is shrunk towards its parent's with a
beta-binomial prior, whose concentration comes from the spread between groups
(method of moments). A host is blocked when the lower bound of its posterior bad
rate exceeds a limit. Explicit rules on host and path come before that.

Everything is DataFrame work: one partial aggregation per level over host counts,
one scalar per level on the driver. Host verdicts are broadcast to the pages
when their measured size allows, else joined by shuffle.

Edge cases: a null url, or one without ``://``, has an empty host and path and is
judged as that host; hosts without outcomes get their parents' prior; outcomes of
unknown pages and null outcomes are ignored; a page with several outcomes is bad
if one is; repeated pages are judged each for itself; with no outcomes at all the
method allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (action, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of more than one label; every other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")
#: Bad rate that a host's lower posterior bound must exceed to be blocked, and the bound's distance in standard deviations.
LIMIT, DEVIATIONS = 0.3, 1.0
#: Concentrations are kept within these bounds.
LEAST, MOST = 1.0, 1000.0
#: Bytes of host verdicts that are broadcast; about 100 a host.
BROADCAST_BYTES = 32 << 20


def host_of(url: str) -> Column:
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    return F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")


def suffix_of(host: Column) -> Column:
    longest = F.substring_index(host, ".", -2)
    return F.when(longest.isin(*LONG_SUFFIXES), longest).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    return F.when(suffix.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES, what: int | None = None) -> Column:
    """The longest fitting rule, as host and path, or its action with ``what=0``."""
    out = F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(action if what == 0 else h + p)).otherwise(out)
    return out


def _concentration(groups: DataFrame, prior: str) -> float:
    """Beta-binomial concentration of groups ``n, bad`` around their prior means, by moments."""
    m = F.col(prior)
    row = groups.agg(
        F.sum(F.pow(F.col("bad") - F.col("n") * m, 2)).alias("spread"), F.sum(F.col("n") * m * (1 - m)).alias("binomial"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("pairs"),
    ).first()
    if not row.pairs or row.pairs <= 0:
        return MOST
    rho = (row.spread - row.binomial) / row.pairs
    return MOST if rho <= 1 / (MOST + 1) else max(LEAST, 1 / rho - 1)


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, prior, concentration, mean, lower`` per host of ``pages(page_id, host)`` from ``outcomes(page_id, bad)``."""
    judged = outcomes.where("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = pages.join(judged, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    suffix = suffix_of(F.col("host"))
    hosts = materialise(labelled.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("host"), suffix)), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total.bad / total.n) if total.n else 0.0

    def shrunk(groups: DataFrame, prior: str, name: str) -> DataFrame:
        k = _concentration(groups, prior)
        return groups.withColumn(name, (F.col("bad") + F.lit(k) * F.col(prior)) / (F.col("n") + F.lit(k)))

    def counts(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    suffixes = shrunk(counts("suffix").withColumn("prior", F.lit(mean)), "prior", "suffix_mean").select("suffix", "suffix_mean")
    domains = shrunk(counts("suffix", "domain").join(suffixes, "suffix"), "suffix_mean", "domain_mean").select("domain", "domain_mean")
    hosts = hosts.join(domains, "domain")
    k = _concentration(hosts, "domain_mean")
    a = F.col("bad") + F.lit(k) * F.col("domain_mean")
    b = F.col("n") - F.col("bad") + F.lit(k) * (1 - F.col("domain_mean"))
    mean_col, size = a / (a + b), a + b
    lower = mean_col - F.lit(DEVIATIONS) * F.sqrt(mean_col * (1 - mean_col) / (size + 1))
    return hosts.select("host", "n", "bad", F.col("domain_mean").alias("prior"), F.lit(k).alias("concentration"), mean_col.alias("mean"), lower.alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, lower`` of every url of ``pages(page_id, url)``."""
    parsed = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    reputation = materialise(host_reputation(parsed.select("page_id", "host"), outcomes).select("host", "lower"), "reputation")
    small = reputation.count() * 100 <= BROADCAST_BYTES
    judged = parsed.join(F.broadcast(reputation) if small else reputation, "host", "left")
    host, path = F.col("host"), F.col("path")
    by_method = F.when(F.col("lower") > LIMIT, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule_of(host, path, rules).alias("rule"), F.coalesce(rule_of(host, path, rules, 0), by_method).alias("verdict"), "lower")
