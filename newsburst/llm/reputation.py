"""URL filter by host reputation: labelled page outcomes, shrunk from host to registered
domain to suffix with beta-binomial priors, and a list of explicit rules that goes first.

Every step is a DataFrame expression, join or aggregate. Outcomes are summed per host before
anything is shuffled by a wider key, so a host with a third of all pages is one row per task.

Defined results: a null url, or one without ``://``, has an empty host and path; an empty host
is judged like any other host. Pages without label rows only add to the host list. With no
labels at all every level has the prior mean, and nothing is blocked by reputation. Several
label rows of one page count once (bad if any is). Repeated page rows are judged alike, one
result row each; other columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query (fixed values).
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Public suffixes of two labels (fixed values); any other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "com.cn", "co.jp", "co.in", "co.nz", "co.za")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(text, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (name, verdict); of two as long, a blocking one."""
    result = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        result = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(
            result
        )
    return result


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """Registered domain (suffix and one label) and suffix of a host."""
    last_two = F.substring_index(host, ".", -2)
    double = last_two.isin(*suffixes) & (host != last_two)
    domain = F.when(double, F.substring_index(host, ".", -3)).otherwise(last_two)
    suffix = F.when(double | last_two.isin(*suffixes), last_two).otherwise(F.substring_index(host, ".", -1))
    return domain, suffix


def _strength(level: DataFrame, default: float) -> float:
    """Prior strength from the spread of the groups' rates around their parents' means, by
    the method of moments for the beta-binomial; one number for a whole level."""
    rate, mean = F.col("bad") / F.col("n"), F.col("parent_mean")
    noise = mean * (1 - mean)
    row = (
        level.filter("n > 0")
        .agg(
            F.sum(F.round(F.col("n") * (rate - mean) * (rate - mean) - noise, 9).cast("decimal(28,9)")).alias("excess"),
            F.sum(F.round(noise * (F.col("n") - 1), 9).cast("decimal(28,9)")).alias("scale"),
        )
        .first()
    )
    if not row.scale or row.excess is None:
        return default
    share = min(max(float(row.excess) / float(row.scale), 0.001), 0.9)
    return 1 / share - 1


def _shrunk(level: DataFrame, strength: float) -> DataFrame:
    prior = F.col("parent_mean") * strength
    return level.withColumn("mean", (prior + F.col("bad")) / (F.lit(strength) + F.col("n")))


def host_reputation(
    pages: DataFrame, outcomes: DataFrame, prior_mean: float = 0.1, prior_strength: float = 10.0, z: float = 1.645
) -> DataFrame:
    """(host, domain, suffix, n, bad, mean, low, high) for every host of ``pages`` (page_id, host).

    ``outcomes`` holds (page_id, bad). mean is the posterior share of bad pages of the host;
    low and high lie ``z`` posterior standard deviations around it.
    """
    outcomes = outcomes.filter("page_id is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = (
        pages.select("page_id", "host")
        .join(outcomes, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"domain": domain, "suffix": suffix})
    )
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    total = suffixes.agg(*counts).first()
    overall = (prior_mean * prior_strength + (total.bad or 0)) / (prior_strength + (total.n or 0))

    suffixes = suffixes.withColumn("parent_mean", F.lit(overall))
    suffixes = _shrunk(suffixes, _strength(suffixes, prior_strength))
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("parent_mean")), "suffix")
    domains = _shrunk(domains, _strength(domains, prior_strength))
    hosts = hosts.join(domains.select("domain", "suffix", F.col("mean").alias("parent_mean")), ["domain", "suffix"])
    strength = _strength(hosts, prior_strength)
    hosts = _shrunk(hosts, strength)
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(strength + 1) + F.col("n")))
    return hosts.select(
        "host", "domain", "suffix", "n", "bad", "mean", (F.col("mean") - z * spread).alias("low"),
        (F.col("mean") + z * spread).alias("high"),
    )


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = 0.2, **prior
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url).

    The longest fitting rule decides; else the host is blocked if even the lower bound of its
    posterior share of bad pages is above ``max_bad``.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = host_reputation(parsed, outcomes, **prior).select("host", (F.col("low") > max_bad).alias("is_bad"))
    return (
        parsed.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
        .join(known, "host", "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("fit.name").alias("rule"),
            F.coalesce("fit.verdict", F.when(F.col("is_bad"), "block").otherwise("allow")).alias("verdict"),
        )
    )
