"""URL filters with link-graph propagation, in DataFrame operations only.

Rules (host, path) decide the urls they fit. For the rest, hosts are judged by the link graph: hosts whose pages the
rules mostly allow are trusted seeds, hosts whose pages they mostly block are blocked seeds; trust is the
personalised PageRank from the trusted seeds along links, distrust the one from the blocked seeds along reversed links. Each seed sends out the same
amount, and what reaches a host without links goes no further, so scores are sums over seeds and seeds that don't reach a host don't change its verdict. A host
is blocked if its distrust makes up more than ``threshold`` of both; a host that neither reaches is allowed.

Pages are aggregated to hosts and links to host edges before anything is joined, so a host with a third of all pages
costs one row; edges are weighted by their number of links. Each step of the propagation is one join and
one map-side combined sum, checkpointed; it ends when scores move by less than ``tolerance`` for each seed, which the damping brings about in a known number of steps.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no links; relative links
and links of a host to itself carry no rank; repeated pages count again; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import keep, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: After the first "://": the host, then the path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of each absolute or scheme-relative link of an anchor.
LINKS = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null: the host or a subdomain of it, and a path that starts with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from pages with host and html."""
    target = F.explode(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINKS), F.lit(1)))
    linked = pages.where(F.contains(F.col("html"), F.lit("//"))).select(F.col("host").alias("src"), target.alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return linked.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: (host, score) from ``seeds`` (host, weight) along ``edges`` (src, dst, n).

    score = (1 - damping) * weight + damping * (sum over links into the host of their part of the source's score).
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    steps = keep(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("part")))
    start = keep(seeds.where("weight > 0").select("host", (F.col("weight") * (1 - damping)).alias("seed")))
    everything = (start.agg(F.sum("seed")).first()[0] or 0.0) / (1 - damping)
    score = start.select("host", F.col("seed").alias("score"))
    # Each step's change is the last one's at most, times the damping.
    for _ in range(math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        moved = score.join(steps, score["host"] == steps["src"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("part")).alias("got"))
        new = keep(
            start.join(moved.withColumnRenamed("dst", "host"), "host", "full")
            .select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("got", F.lit(0.0)) * damping).alias("score"))
        )
        change = new.join(score.withColumnRenamed("score", "old"), "host", "left").agg(F.sum(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0
        score = new
        if change <= tolerance * everything:
            break
    return score


def host_verdicts(hosts: DataFrame, edges: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(host, trust, distrust, verdict) from hosts (host, pages, allowed, blocked) and host edges."""
    trusted = hosts.where("2 * allowed > pages").select("host", F.lit(1.0).alias("weight"))
    blocked = hosts.where("2 * blocked > pages").select("host", F.lit(1.0).alias("weight"))
    trust = propagate(edges, trusted, **options).withColumnRenamed("score", "trust")
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(reverse, blocked, **options).withColumnRenamed("score", "distrust")
    scored = hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    return scored.select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html)."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = split.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    judged = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"))
    hosts = keep(
        judged.groupBy("host").agg(
            F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")
        )
    )
    edges = keep(host_edges(split))
    verdicts = host_verdicts(hosts.where("host <> ''"), edges, threshold, **options).select("host", F.col("verdict").alias("by_host"))
    joined = judged.join(small(keep(verdicts)), "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_urls": op6_urls}
