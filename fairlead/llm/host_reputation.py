"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Pages whose outcome is known (a rule decides them, or the caller labels them) are counted per host. A rate of bad pages is beta
distributed; the prior of a host is its registered domain, that of a domain its suffix, that of a suffix the whole table. Each
level's prior strength is estimated from all of its children by the method of moments, so a host with few labelled pages stays
near its domain and one with many speaks for itself. A page is blocked if even the lower posterior bound of its host's bad rate
passes the threshold; doubt about a prior counts, so a host without evidence of its own is judged by what is sure of its kind.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and have only the prior of the table. Only sums per
host are shuffled; pages meet their host's verdict in a join that Spark broadcasts or splits by size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many posterior standard deviations below the mean the bound lies, and the bad rate that it must pass.
DEVIATIONS, THRESHOLD = 1.645, 0.5
#: Least and most prior strength (in pages), and the strength of the table's own prior.
WEAKEST, STRONGEST, ROOT = 1.0, 1000.0, 2.0
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``(rule, verdict)`` that fits, as a struct; null if none. Rules are a short list, longest first here."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def reputation(outcomes: DataFrame) -> DataFrame:
    """``host, bound`` from ``host, bad (boolean), known (boolean)``; every host of the input gets a row.

    The registered domain is the host's last two labels, the suffix its last label.
    """
    hosts = outcomes.groupBy("host").agg(F.sum(F.col("known").cast("long")).alias("n"), F.sum((F.col("known") & F.col("bad")).cast("long")).alias("bad"))
    hosts = hosts.select("host", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"), "n", "bad")
    totals = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = totals(hosts, "domain", "suffix")  # a domain has one suffix
    suffixes = totals(domains, "suffix")
    n, bad = (F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "bad"))
    rate = (bad + 1) / (n + ROOT)
    root = suffixes.agg(F.struct(rate.alias("prior"), (rate * (1 - rate) / (n + ROOT + 1)).alias("doubt"))).scalar()

    def with_strength(children: DataFrame) -> DataFrame:
        # moments over all children of a level: var = m (1 - m) / (strength + 1), beside the sampling noise of each child
        spread = F.col("prior") * (1 - F.col("prior"))
        moments = children.where("n > 0").agg(
            F.sum(F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) - spread / F.col("n")).alias("between"),
            F.sum(spread * (1 - 1 / F.col("n"))).alias("most"),
        )
        fitted = F.when(F.col("between") > 0, F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), F.col("most") / F.col("between") - 1))).otherwise(STRONGEST)
        return children.withColumn("strength", moments.select(F.round(F.coalesce(fitted, F.lit(STRONGEST)), 9)).scalar())

    def posterior(children: DataFrame, *keys: str) -> DataFrame:
        # a child's doubt is its own posterior variance and as much of its parent's as its mean hangs on
        total = F.col("n") + F.col("strength")
        means = with_strength(children).withColumn("mean", (F.col("bad") + F.col("prior") * F.col("strength")) / total)
        doubt = F.col("mean") * (1 - F.col("mean")) / (total + 1) + F.pow(F.col("strength") / total, 2) * F.col("doubt")
        return means.select(*keys, "mean", doubt.alias("doubt"))

    def under(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        return children.join(parents.select(key, F.col("mean").alias("prior"), "doubt"), key)

    at_suffix = posterior(suffixes.withColumn("root", root).select("suffix", "n", "bad", "root.prior", "root.doubt"), "suffix")
    at_domain = posterior(under(domains, at_suffix, "suffix"), "domain")
    at_host = posterior(under(hosts, at_domain, "domain"), "host")
    return at_host.select("host", (F.col("mean") - DEVIATIONS * F.sqrt("doubt")).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", label: Column | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, bound``. ``label``: true for pages known to be bad, false for good, else null."""
    found = ruled(F.col("_host"), F.col("_path"), rules)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "bound")]
    parts = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))}).withColumn("_found", found)
    outcome = F.col("_found.verdict") == "block"
    if label is not None:
        outcome = F.coalesce(label, outcome)
    known = parts.select(F.col("_host").alias("host"), outcome.isNotNull().alias("known"), F.coalesce(outcome, F.lit(False)).alias("bad"))
    judged = parts.join(reputation(known).withColumnRenamed("host", "_host"), "_host", "left")
    method = F.when(F.round(F.col("bound"), 9) > THRESHOLD, "block").otherwise("allow")
    return judged.select(
        *kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_found.rule").alias("rule"), F.coalesce(F.col("_found.verdict"), method).alias("verdict"), "bound"
    )
