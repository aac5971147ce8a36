"""URL filters as a sort-merge range join (DataFrame functions only).

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with
the rule's. In the canonical key, reversed host labels + NUL + path in UTF-8, the urls that
a rule fits at its own host are the interval [key, key + 0xFF). A url enters the join once
for each suffix of its host that is as short as a rule's host can be, so subdomains fall
into that interval as well. (One entry isn't enough: with path rules on all subdomains, what a
rule fits is no interval of any order of hosts and paths, since the path counts after any label
that a subdomain has. Entries are kept only where a host of a rule is met.) Intervals of prefixes are nested or disjoint, therefore a sweep
in key order can keep the active ones on a stack: the running sum of starts and ends is the
stack's height, and what lies on top for a url is the last rule started at that height.

Sweeps are split by suffix host, and a host with many urls by a hash of the path, to each
part of which the rules of that host are copied: parts hold ``SWEEP_URLS`` urls, or as many
as the host has rules, so that copies of rules never outnumber urls. Urls are made distinct
first, so a url that a third of all rows share is judged once. Of the rules that fit a url at different hosts,
the longest (characters of host and path) wins, then the one with the longer host.

Defined cases: null urls and urls without ``://`` have empty host and path, and no rule with
a host fits them; equal rules with different verdicts block; null verdict, host or path
drops a rule, and no rules leave every url to ``default``; repeated rows are all returned.
Columns of the input stay, except where they clash with host, path, rule and verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise

#: Urls that one sweep gets of one host, unless the host has more rules.
SWEEP_URLS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path."""
    split = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    keep = [c for c in df.columns if c.lower() not in ("host", "path")]
    return df.select(*keep, F.translate(F.regexp_extract(text, split, 1), UPPER, LOWER).alias("host"), F.regexp_extract(text, split, 2).alias("path"))


def _key(host, path):
    return F.concat(F.encode(F.concat(host, F.lit("\0"), path), "UTF-8"))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (its host and path, or null) and verdict."""
    labels = F.split("host", r"\.")
    rules = rules.where("verdict is not null and host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("_rev", F.array_join(F.reverse(labels), "."))
    deepest = rules.agg(F.max(F.size(labels))).first()[0] or 0

    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # rows in a struct, so that no column's name can clash with those of the sweep
    row = F.struct(*keep) if keep else F.struct(F.lit(0))
    parsed = url_parts(pages.select(row.alias("_row"), F.col(url).alias("_url")), "_url").select("_row", "host", "path")
    urls = materialise(parsed.select("host", "path").distinct(), "urls")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))), lambda i: F.array_join(F.slice(F.reverse(labels), 1, i), "."))
    at = urls.select("host", "path", F.explode(suffixes).alias("_rev")) if deepest else urls.select("host", "path", F.lit("").alias("_rev")).where("false")
    at = materialise(at.join(rules.select("_rev").distinct(), "_rev", "left_semi"), "suffixes")

    load = at.groupBy("_rev").agg(F.count(F.lit(1)).alias("n")).join(rules.groupBy("_rev").agg(F.count(F.lit(1)).alias("m")), "_rev")
    # a row for each host of a rule, whose size Spark knows once it is written
    parts = materialise(load.select("_rev", F.ceil(F.col("n") / F.greatest(F.lit(SWEEP_URLS), "m")).cast("int").alias("_parts")), "parts")
    one = F.coalesce("_parts", F.lit(1))

    queries = at.join(parts, "_rev", "left").select("_rev", F.pmod(F.xxhash64("path"), one).cast("int").alias("_part"), _key(F.col("_rev"), F.col("path")).alias("_pos"), F.lit(1).alias("_kind"), "host", "path", F.lit(None).cast("struct<host:string,path:string,verdict:string>").alias("_rule"))
    opened = rules.join(parts, "_rev", "left").select("_rev", F.explode(F.sequence(F.lit(0), one - 1)).alias("_part"), _key(F.col("_rev"), F.col("path")).alias("_pos"), F.struct("host", "path", "verdict").alias("_rule"))
    none = F.lit(None).cast("string")
    starts = opened.select("_rev", "_part", "_pos", F.lit(0).alias("_kind"), none.alias("host"), none.alias("path"), "_rule")
    ends = starts.withColumns({"_pos": F.concat("_pos", F.unhex(F.lit("FF"))), "_kind": F.lit(2)})

    sweep = W.partitionBy("_rev", "_part").orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    events = queries.unionByName(starts).unionByName(ends).withColumn("_height", F.sum(1 - F.col("_kind")).over(sweep))
    stack = W.partitionBy("_rev", "_part", "_height").orderBy("_pos", "_kind").rowsBetween(W.unboundedPreceding, 0)
    fits = events.where("_kind < 2 and _height > 0").withColumn("_top", F.last("_rule", True).over(stack)).where("_kind = 1")
    length = F.struct(F.length("_top.host") + F.length("_top.path"), F.length("_top.host"))
    # written, so that the last join has two plain exchanges, and urls that many rows share can be split
    best = materialise(fits.groupBy("host", "path").agg(F.max_by("_top", length).alias("_best")), "best")
    verdict = F.coalesce("_best.verdict", F.lit(default))
    judged = parsed.join(best, ["host", "path"], "left")
    return judged.select(*[F.col("_row")[c].alias(c) for c in keep], "host", "path", F.concat("_best.host", "_best.path").alias("rule"), verdict.alias("verdict"))
