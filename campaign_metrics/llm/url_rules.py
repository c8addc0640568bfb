"""URL allow/block rules by a trie over reversed host labels and path segments.

Rules are a parameter of the operator: ``(host, path, verdict)``. They are compiled into tries of
at most ``SHARD_RULES`` rules; one trie is broadcast per shard, so no broadcast grows beyond
that bound, and the shards' longest matches are compared in the plan.

Defined cases: a null url or one without ``://`` has empty host and path and meets no rule; a
rule fits its host and every subdomain when the url's path starts with the rule's path (character
by character); more host labels beat fewer, then the longer path wins; block beats allow between
equal rules. Repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaign_metrics.llm.tables import lower_ascii

SHARD_RULES = 200_000


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str  # allow or block


class HostPathTrie:
    """Longest-match lookup; nodes are dicts, so a trie pickles small and fast."""

    def __init__(self, rules: Iterable[UrlRule]):
        self.root: dict = {"next": {}}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.lower().split(".")):
                node = node["next"].setdefault(label, {"next": {}})
            *whole, part = rule.path.split("/")
            paths = node.setdefault("paths", {"next": {}, "parts": {}})
            for segment in whole:
                paths = paths["next"].setdefault(segment, {"next": {}, "parts": {}})
            old = paths["parts"].get(part)
            if old is None or rule.verdict == "block":
                paths["parts"][part] = rule

    @staticmethod
    def _longest(paths: dict, segments: list[str]) -> UrlRule | None:
        best = None
        for segment in segments:
            for size in range(len(segment), -1, -1) if paths["parts"] else ():
                rule = paths["parts"].get(segment[:size])
                if rule is not None:
                    best = rule
                    break
            paths = paths["next"].get(segment)
            if paths is None:
                break
        return best

    def find(self, host: str, path: str) -> UrlRule | None:
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node["next"].get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._longest(node["paths"], segments) or best
        return best


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shard_match(spark, rules: list[UrlRule]):
    shared = spark.sparkContext.broadcast(HostPathTrie(rules))

    @F.pandas_udf("labels int, chars int, blocks int, rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = shared.value.find
        out = []
        for h, p in zip(host, path):
            r = find(h, p)
            out.append((-1, -1, 0, None, None) if r is None else
                       (r.host.count(".") + 1, len(r.path), int(r.verdict == "block"), r.host + r.path, r.verdict))
        return pd.DataFrame(out, columns=["labels", "chars", "blocks", "rule", "verdict"])

    return match


def judge_urls(pages: DataFrame, rules: list[UrlRule], default: str = "allow", shard_rules: int = SHARD_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ordered = sorted(set(rules))
    found = [
        _shard_match(spark, ordered[i:i + shard_rules])("host", "path")
        for i in range(0, len(ordered), shard_rules)
    ]
    best = F.lit(None).cast("struct<labels:int,chars:int,blocks:int,rule:string,verdict:string>")
    if found:
        best = found[0] if len(found) == 1 else F.greatest(*found)
    judged = parts.withColumn("best", best)
    return judged.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
