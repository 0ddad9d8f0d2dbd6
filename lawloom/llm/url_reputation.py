"""Empirical-Bayes host reputation for url filtering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

# Public suffixes of several labels, as far as no list is given; any other suffix is the last label.
SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "net.au", "org.au", "org.uk"]

# The rules of the query, host and path with their verdicts.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Fit:
    """Bad rate of all labelled pages, and the prior's weight in pages at each level."""

    rate: float
    suffix: float
    domain: float
    host: float


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def site_of(host: Column, suffixes: list[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, its port left aside.

    The suffix is the longest of ``suffixes`` (such as the public suffix list) that the host ends in, else its last
    label; the domain has one label more, if there is one. An IP address is its own domain, under the suffix ``ip``.
    """
    name = F.regexp_replace(host, r":[0-9]*$", "")
    is_ip = name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    tail = lambda n: F.substring_index(name, ".", -n)
    suffix, domain = tail(1), tail(2)
    for n in sorted({s.count(".") + 1 for s in suffixes} - {1}):
        own = tail(n).isin([s for s in suffixes if s.count(".") + 1 == n])
        suffix, domain = F.when(own, tail(n)).otherwise(suffix), F.when(own, tail(n + 1)).otherwise(domain)
    return F.when(is_ip, name).otherwise(domain), F.when(is_ip, F.lit("ip")).otherwise(suffix)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _weight(groups: DataFrame, above: str | None) -> float:
    """Pages that the beta prior of one level counts for, by the method of moments within the level above.

    For rows (n, bad) of groups that share ``above`` (all, if it is None), with that one's rate p: the squares of
    bad - n p, over n, exceed what binomial chance explains in proportion to the correlation within
    groups; its inverse less 1 is the weight. It is kept in 1 to 1,000: a prior counts for one page at least, and
    for a thousand where groups differ no more than by chance, or none are left to compare.
    """
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    own = groups.where("n > 0").groupBy(*[above] if above else []).agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb")
    )
    # The sum of (bad - n p) ** 2 / n over groups with the rate p = sum(bad) / sum(n).
    squares = F.col("bb") - F.col("bad") * F.col("bad") / F.col("n")
    chance = F.col("bad") / F.col("n") * (1 - F.col("bad") / F.col("n"))
    free = F.col("k") - 1
    room = F.col("n") - F.col("nn") / F.col("n") - free
    s = own.where("k > 1").agg(F.sum(squares - chance * free).alias("excess"), F.sum(chance * room).alias("room")).first()
    if not s["room"] or s["room"] <= 0 or s["excess"] <= 0:
        return 1000.0
    return min(1000.0, max(1.0, s["room"] / s["excess"] - 1))


def host_reputation(hosts: DataFrame, *, z: float = 1.645, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Posterior bad rate of each host and its lower bound, from rows (host, n, bad), read several times.

    Rates are shrunk in turn: suffixes towards the rate of all pages, registered domains
    towards their suffix, hosts towards their domain, each by a beta-binomial prior whose
    weight is fitted to the differences within the level above (``_weight``). The bound is the
    posterior's lower quantile at ``z`` standard deviations with the skewness term of the
    Cornish-Fisher expansion.
    """
    domain, suffix = site_of(F.col("host"), suffixes)
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums), "domains")
    by_suffix = domains.groupBy("suffix").agg(*sums)
    total = by_suffix.agg(*sums).first()
    rate = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 10)
    fit = Fit(rate, _weight(by_suffix, None), _weight(domains, "suffix"), _weight(hosts, "domain"))

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.col("bad") + prior * weight) / (F.col("n") + weight)

    by_suffix = by_suffix.select("suffix", shrunk(F.lit(fit.rate), fit.suffix).alias("suffix_rate"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_rate"), fit.domain).alias("domain_rate"))
    a = F.col("bad") + F.col("domain_rate") * fit.host
    b = F.col("n") - F.col("bad") + (1 - F.col("domain_rate")) * fit.host
    mean = a / (a + b)
    deviation = F.sqrt(a * b / (a + b + 1)) / (a + b)
    skew = 2 * (b - a) * F.sqrt(a + b + 1) / ((a + b + 2) * F.sqrt(a * b))
    bound = mean + deviation * (-z + skew * (z * z - 1) / 6)
    return hosts.join(by_domain, "domain").select("host", "n", "bad", mean.alias("bad_rate"), bound.alias("bad_bound"))


def judge_urls(
    pages: DataFrame, labels: DataFrame, *, rules: list[tuple[str, str]] = RULES, suffixes: list[str] = SUFFIXES, max_bad: float = 0.4, z: float = 1.645
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_labelled, bad_rate, bad_bound.

    A labelled page (label of the same id) is bad when its quality is 0 or it is toxic. Where
    no rule fits, a host is blocked when the lower bound of its posterior bad rate is over
    ``max_bad``; so a host with few labels is judged by its domain and suffix. Labels are
    summed by host map-side before they are shuffled and written once, so a hot host costs one row
    a task, and Spark broadcasts the reputations if they are small, or else splits the hot host's
    join. Pages are read twice: for the sums, and for the verdicts.

    Cases: null urls and urls without :// have an empty host and path and are judged like the
    unlabelled host they form; null labels count as neither bad nor labelled; several labels of
    one page count as bad if any is; repeated pages are each judged and each counted; without labels
    no host is blocked; other columns of both tables, whatever their names, are not read; empty tables give no rows.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = (
        labels.where(F.col("quality").isNotNull() | F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad).alias("bad"))
    )
    counted = (
        split.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    reputation = host_reputation(materialise(counted, "hosts"), z=z, suffixes=suffixes)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.col("bad_bound") > max_bad, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, by_bound).alias("verdict"), F.col("n").alias("n_labelled"), "bad_rate", "bad_bound"
    )
