"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled pages count as good or bad outcomes of their host. A host's bad rate is
shrunk towards its registered domain's, that towards its suffix's, and that towards
the rate of all: at each level the prior is a beta distribution around the parent's
posterior mean whose weight, in pages, comes from how much the level's nodes vary
beyond binomial chance (moments of the beta-binomial, each node with two labelled
pages or more counting once). A host is blocked when the
lower posterior bound of its bad rate, mean - z sd, is above ``limit``, so that a
few bad pages do not block a host and hosts without labels follow their domain.

A host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z lower-cased; its suffix is the last label and its registered domain the last
two (``long_suffixes`` names suffixes of two labels, whose domains have three), ports
left out; an address is its own domain and suffix.

A rule ``host/path`` fits its host and all subdomains if the path starts with the
rule's path, slash included; of several the longest wins, and a rule's verdict
stands above the host's reputation.

Pages are joined with a row a host, after outcomes have been summed by host with a
combine before the shuffle; the join is one that adaptive execution can split.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, and the reputation of all; labels that are null or match no page are ignored,
and of several labels of a page each counts; repeated pages are judged alike;
without labels nothing is blocked by reputation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

#: Fixed rules: pattern and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, LIMIT = 1.645, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null; of equal length the first."""
    found = F.lit(None).cast("string")
    for pattern, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        rule_host, slash, rest = pattern.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(pattern)).otherwise(found)
    return found


def levels(host: Column, long_suffixes: tuple[str, ...] = ()) -> dict[str, Column]:
    named = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.when(named.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), F.array(named)).otherwise(F.split(named, r"\.", -1))
    size = F.size(labels)
    two = F.concat_ws(".", F.slice(labels, F.greatest(size - 1, F.lit(1)), 2))
    long = two.isin(*long_suffixes) if long_suffixes else F.lit(False)
    suffix = F.when(long, two).otherwise(F.element_at(labels, -1))
    domain = F.when(long, F.concat_ws(".", F.slice(labels, F.greatest(size - 2, F.lit(1)), 3))).otherwise(two)
    return {"suffix": suffix, "domain": domain}


def _shrunk(nodes: DataFrame) -> DataFrame:
    """nodes(key, bad, n, parent mean) with the posterior ``mean`` and ``weight``."""
    spread = F.col("parent") * (1 - F.col("parent"))
    n = F.col("n")
    beyond = F.avg(((F.col("bad") - n * F.col("parent")) ** 2 / spread - n) / (n * (n - 1)))
    beyond = F.greatest(F.least(F.coalesce(beyond, F.lit(0.1)), F.lit(0.9)), F.lit(0.001))
    prior = nodes.where((n > 1) & (spread > 0)).agg(beyond.alias("rho")).select((1 / F.col("rho") - 1).alias("prior"))
    return nodes.crossJoin(F.broadcast(prior)).withColumns({"mean": (F.col("bad") + F.col("prior") * F.col("parent")) / (F.col("n") + F.col("prior")), "weight": F.col("n") + F.col("prior")}).drop("prior")


def reputations(outcomes: DataFrame, long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """outcomes(host, bad 0/1 or null) to a row a host: n, bad, mean and weight of the posterior. Hosts without an outcome are rows too."""
    known = F.col("bad").isNotNull().cast("long")
    hosts = outcomes.groupBy("host").agg(F.sum(known).alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = checkpoint(hosts.withColumns(levels(F.col("host"), long_suffixes)))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(((F.col("bad") + 0.5) / (F.col("n") + 1)).alias("parent"))
    suffixes = checkpoint(_shrunk(hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).crossJoin(F.broadcast(whole))))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = checkpoint(_shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("parent")), "suffix")))
    return _shrunk(hosts.join(domains.select("domain", F.col("mean").alias("parent")), "domain")).select("host", "n", "bad", "mean", "weight")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z, long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """pages(page_id, url), labels(page_id, bad): page_id, host, path, rule, verdict, bad_rate, bad_rate_bound."""
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").select("page_id", "bad")
    found = reputations(seen.select("page_id", "host").join(known, "page_id", "left").select("host", "bad"), long_suffixes)
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    found = found.select(F.col("host").alias("h"), F.col("mean").alias("bad_rate"), bound.alias("bad_rate_bound"))
    verdicts = F.when(F.col("bad_rate_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    for pattern, verdict in rules:
        verdicts = F.when(F.col("rule") == pattern, F.lit(verdict)).otherwise(verdicts)
    ruled = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.join(found, ruled["host"] == found["h"]).select("page_id", "host", "path", "rule", verdicts.alias("verdict"), "bad_rate", "bad_rate_bound")
