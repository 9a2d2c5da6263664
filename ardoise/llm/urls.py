"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled pages say how often a host gives a bad page.  Few labels say little, so a host's rate is shrunk
towards that of its registered domain, and the domain's towards that of its suffix, by beta-binomial
priors whose strengths are estimated from all hosts.  A host is blocked when even the lower bound of its
posterior rate is above the limit.  All steps are DataFrame expressions.

Defined results: a url that is null or has no ``://`` has an empty host and path; the empty host is judged
like any other.  Repeated pages count as often as they occur.  Pages without an outcome count for nothing.
An empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import join_lookup
from ardoise.sources.workdir import materialise

# The site rules, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A host is blocked when its bad rate is above LIMIT at Z standard deviations below the posterior mean.
LIMIT, Z = 0.5, 1.645
#: Bounds of the strength of a prior, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    dotted = F.concat(F.lit("."), host)
    ordered = sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)

    def pick(value):
        return reduce(
            lambda c, r: c.when(dotted.endswith(f".{r[1]}") & path.startswith(r[2]), F.lit(value(r))),
            ordered[1:],
            F.when(dotted.endswith(f".{ordered[0][1]}") & path.startswith(ordered[0][2]), F.lit(value(ordered[0]))),
        )

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _strength(children: DataFrame) -> DataFrame:
    """One row: the prior's strength from the spread of the children's rates around their parents'.

    ``children`` has n and bad of each child and pn, pbad of its parent.
    """
    p = F.col("pbad") / F.col("pn")
    inside = p * (1 - p)
    parts = children.where("n > 0").select(
        (F.col("n") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("s"),
        inside.alias("v"),
        (F.col("n") - F.col("n") * F.col("n") / F.col("pn")).alias("d"),
        (inside * F.col("n") / F.col("pn")).alias("one"),
        (F.col("n") / F.col("pn")).alias("share"),
    )
    # Of each parent one degree of freedom is lost; a child carries its share of it.
    t = parts.agg(
        F.sum("s").alias("s"),
        F.sum(F.col("v") - F.col("one")).alias("noise"),
        F.sum(F.col("v") * F.col("d") - (F.col("v") - F.col("one"))).alias("room"),
    )
    rho = F.when(F.col("room") > 0, (F.col("s") - F.col("noise")) / F.col("room")).otherwise(F.lit(0.0))
    m = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONGEST))
    return t.select(F.coalesce(F.least(F.greatest(m, F.lit(WEAKEST)), F.lit(STRONGEST)), F.lit(STRONGEST)).alias("m"))


def host_reputation(pages: DataFrame, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """One row per host with n, bad, posterior mean and lower bound of the bad rate, and the verdict.

    ``pages``: host, and bad (1, 0 or null without a label), one row per page.  Counting has map-side
    partials, so a host with a third of all pages is one row per task.
    """
    suffix = F.substring_index("host", ".", -1)
    domain = F.substring_index("host", ".", -2)
    hosts = materialise(
        pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumns({"suffix": suffix, "domain": domain}),
        "hosts",
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    whole = suffixes.agg(F.sum("sn").alias("n"), F.sum("sbad").alias("bad")).first()
    everywhere = ((whole["bad"] or 0) + 1.0) / ((whole["n"] or 0) + 2.0)
    level = domains.join(suffixes, "suffix")
    strong_d = _strength(level.selectExpr("dn n", "dbad bad", "sn pn", "sbad pbad")).first()["m"]
    strong_h = _strength(hosts.join(domains, ["domain", "suffix"]).selectExpr("n", "bad", "dn pn", "dbad pbad")).first()["m"]
    s_mean = (F.col("sbad") + everywhere) / (F.col("sn") + 1)
    d_mean = (F.col("dbad") + strong_d * F.col("s_mean")) / (F.col("dn") + strong_d)
    domains = level.withColumn("s_mean", s_mean).withColumn("d_mean", d_mean).select("domain", "suffix", "d_mean")
    total = F.col("n") + strong_h
    mean = (F.col("bad") + strong_h * F.col("d_mean")) / total
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return (
        hosts.join(domains, ["domain", "suffix"])
        .withColumn("mean", mean)
        .withColumn("low", low)
        .select("host", "n", "bad", "mean", "low", F.when(F.col("low") > limit, "block").otherwise("allow").alias("verdict"))
    )


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", outcome: str = "bad") -> DataFrame:
    """``key``, host, path, rule and verdict of every row of ``pages``."""
    host, path = url_parts(F.col(url))
    cut = pages.select(F.col(key).alias("_key"), F.col(outcome).cast("long").alias("bad"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"))
    scores = materialise(host_reputation(cut).select("host", F.col("verdict").alias("_method")), "reputation")
    return join_lookup(cut, scores, ["host"]).select(
        F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("_method")).alias("verdict")
    )
