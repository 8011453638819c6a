"""URL filters: rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages are counted per host. A host's rate of bad pages is shrunk towards that of its registered domain, the
domain's towards that of its suffix, and the suffix's towards that of all pages, each through a beta-binomial prior
whose strength comes from how much the rates of its members differ (method of moments). A host is blocked if a lower
bound of its posterior rate lies above the limit, so a host with little evidence passes.

Everything is built-in functions: urls are read once, counts are grouped per host, and levels above are small
aggregates of those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staffline.llm.common import ascii_lower

#: Suffixes of two labels under which domains are registered; any other suffix is the last label.
DOUBLE_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: Bounds of the strength of a prior, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Standard deviations of the posterior below its mean, and the rate that blocks.
SURE, LIMIT = 2.0, 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does.

    A rule such as ``example.net/en/`` fits its host and all subdomains where the path starts with the rule's. Of equally
    long rules the one with the longer host wins. ``rules`` is a list in the plan, for tens to hundreds of rules.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, decision in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[0])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{start}"))
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(decision)).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host of one label is its own domain and suffix."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    double = two.isin(*DOUBLE_SUFFIXES) & (F.size(labels) > 2)
    return F.when(double, F.substring_index(host, ".", -3)).otherwise(two), F.when(double, two).otherwise(F.substring_index(host, ".", -1))


def _shrunk(members: DataFrame, by: str) -> DataFrame:
    """``members`` (by, n, bad, prior) with the strength of their group's prior and their own shrunk rate.

    The strength follows from how far the members' rates lie from the prior, beyond what chance makes of their sizes. Groups
    are summed before they are shuffled, so a domain of millions of hosts is no large task.
    """
    n, prior = F.col("n"), F.col("prior")
    own = F.coalesce(F.try_divide("bad", n), F.lit(0.0))
    sums = members.groupBy(by).agg(
        F.sum(n * (own - prior) * (own - prior)).alias("_spread"), F.greatest(F.sum(n), F.lit(1)).alias("_n"),
        F.count_if(n > 0).alias("_members"), F.max(prior).alias("_prior"),
    )
    chance = F.col("_prior") * (1 - F.col("_prior"))
    true = F.col("_spread") / F.col("_n") - chance * F.col("_members") / F.col("_n")
    found = F.when((F.col("_members") > 1) & (true > 0), F.try_divide(chance, true) - 1).otherwise(F.lit(STRONGEST))
    strength = F.round(F.least(F.greatest(F.coalesce(found, F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST)), 6)
    joined = members.join(sums.select(by, strength.alias("strength")), by)
    return joined.withColumn("rate", F.round((F.col("bad") + prior * F.col("strength")) / (n + F.col("strength")), 6))


def reputation(outcomes: DataFrame, sure: float = SURE, limit: float = LIMIT) -> DataFrame:
    """(host, n, bad, rate, lower, blocked) from ``outcomes`` (host, bad: 0, 1 or null), for every host in it.

    ``n`` counts labelled pages. Rates are rounded to six digits at each level, so that sums in any order agree.
    """
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # All pages: a rate from counts plus one page of each kind.
    suffixes = suffixes.withColumn("root", F.lit(0))
    top = suffixes.groupBy("root").agg(F.round((F.sum("bad") + 1) / (F.sum("n") + 2), 6).alias("prior"))
    suffixes = _shrunk(suffixes.join(top, "root"), "root")
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), "suffix")
    hosts = _shrunk(hosts.join(domains.select("domain", F.col("rate").alias("prior")), "domain"), "domain")
    n = F.col("n")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (n + F.col("strength") + 1))
    lower = F.round(F.col("rate") - sure * spread, 6)
    return hosts.select("host", "n", "bad", "rate", lower.alias("lower"), (lower > limit).alias("blocked"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    label_id: str = "doc_id", label: str = "quality", sure: float = SURE, limit: float = LIMIT,
) -> DataFrame:
    """(id, host, path, rule, verdict, rate, lower) of every row of ``pages``.

    A page is bad if its label is 0. Null urls and urls without ``://`` have empty host and path and share the reputation of the
    empty host. Null ids have no label; an id with several labels counts once, as its lowest. Repeated rows are all judged and
    count as often. Extra columns are ignored. An empty table gives an empty one.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_labelled")).agg((1 - F.min(label)).alias("bad"))
    outcomes = rows.join(known, rows[id_col] == known["_labelled"], "left").select("host", F.col("bad").cast("long").alias("bad"))
    found = reputation(outcomes, sure, limit)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.join(found, "host", "left")
    own = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "rate", "lower")
