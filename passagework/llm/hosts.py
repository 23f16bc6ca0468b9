"""URL filter by propagation on the link graph between hosts.

Path rules judge the urls they fit. For the others a host is judged: trust starts at hosts in proportion to their allowed
pages and follows links forward (personalised PageRank); distrust starts at hosts in proportion to their blocked pages and
follows links backward, for who links to bad hosts is suspect. A linker takes its distrust in proportion to its own out-links,
so a farm of many hosts that point at one blocked host fares no better than a single one. A host is blocked where distrust
exceeds trust by ``margin``.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.plans.stage import stage

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of the seeds' mass that may still be on its way when the rounds end.
DAMPING, TOLERANCE, MARGIN = 0.85, 5e-5, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rounds between two cuts of the lineage.
_CUT = 4


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, ASCII letters lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path begins the url's."""
    column = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        column = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(column)
    return column


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: absolute links in ``html`` between different hosts, counted with map-side combine."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'<>]+)"), F.lit(1))
    ends = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(links)).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return ends.select("src", dst.alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, score``: the fixed point of ``score = seed + damping * sum of shares of the hosts that link here``.

    ``seeds`` has host and seed, ``edges`` src, dst and share (those of a src, or those of a dst, sum to 1 at most). Each round
    is one join on the source, whose hot hosts the adaptive join splits, and one sum with map-side combine. A round sends
    ``damping`` of the last one's mass (or of its largest score) at most, so ``tolerance`` sets the number of rounds whatever the graph; they stop
    before that when nothing is sent.
    """
    score = seeds.select("host", F.col("seed").cast("double").alias("score"))
    sent = score.where("score > 0")
    for turn in range(math.ceil(math.log(tolerance) / math.log(damping))):
        sent = edges.join(sent, edges.src == sent.host).groupBy("dst").agg((F.lit(damping) * F.sum(F.col("share") * F.col("score"))).alias("score")).withColumnRenamed("dst", "host")
        score = score.unionByName(sent).groupBy("host").agg(F.sum("score").alias("score"))
        if turn % _CUT == _CUT - 1:
            sent, score = stage(sent, "sent"), stage(score, "scores")
            if sent.isEmpty():
                break
    return score


def host_scores(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust`` for every host of ``pages`` and every host they link to."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select(host.alias("host"), fitting_rule(host, path, rules)["verdict"].alias("verdict")).where("host <> ''")
    share = lambda verdict: F.count(F.when(F.col("verdict") == verdict, 1)) / F.count("*")
    seeds = stage(judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    links = stage(host_links(pages), "links")
    if links.isEmpty():
        return seeds
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    forward = stage(links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "forward")
    backward = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share")
    trust = spread(seeds.select("host", F.col("trust").alias("seed")), forward, damping, tolerance).withColumnRenamed("score", "trust")
    distrust = spread(seeds.select("host", F.col("distrust").alias("seed")), backward, damping, tolerance).withColumnRenamed("score", "distrust")
    both = trust.join(distrust, "host", "full")
    return both.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def url_verdicts(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, margin: float = MARGIN) -> DataFrame:
    """Per row of ``pages`` (repeated rows too): page_id, host, path, rule, verdict, trust, distrust.

    A url that is null or has no ``://`` has empty host and path, fits no rule and is allowed; null html has no links. Hosts
    are joined by name, and a host with a third of all pages is split by the adaptive join.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    joined = urls.join(stage(host_scores(pages, rules, damping, tolerance), "hosts"), "host", "left")
    blocked = F.coalesce(F.col("distrust") - F.col("trust") > margin, F.lit(False))
    return joined.select(
        "page_id", "host", "path", "fit.rule", F.coalesce("fit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
