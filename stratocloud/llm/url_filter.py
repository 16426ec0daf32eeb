"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks.

A rule names a host and the start of a path. It fits that host and all its subdomains if the
URL's path starts with the rule's. Of the rules that fit, the one with the most host labels wins,
then the one with the longest path; of an allow and a block entry for the same place, block wins.

The trie is broadcast only if the rules number at most ``max_broadcast``; more rules are matched by
an equi-join of each URL's host suffixes and path prefixes with the table of rules, with the same result.

Edge cases: a null URL, or one without ``://``, has an empty host and path and fits no rule. An
empty rule host fits no URL. Null ids and repeated rows are judged like any. An empty table gives
an empty result; extra columns are ignored. URLs of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BROADCAST = 200_000


class UrlRule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


class HostPathTrie:
    """Nodes are dicts: host labels from the last to the first, then None, then whole path segments.

    The part of a rule's path behind its last slash ends it: ``ends`` lists (part, verdict, rule).
    """

    def __init__(self, rules: list[UrlRule]):
        self.root: dict = {}
        for r in sorted(rules, key=lambda r: r.verdict != "allow"):  # block entries replace allow entries
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, part = r.path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(("ends",), {})[part] = (r.verdict, r.name)

    @staticmethod
    def _deepest(node: dict, path: str) -> tuple[str, str] | None:
        found, segments = None, path.split("/")
        for k, segment in enumerate(segments):
            ends = node.get(("ends",))
            if ends:
                rest = "/".join(segments[k:])
                fits = [p for p in ends if rest.startswith(p)]
                if fits:
                    found = ends[max(fits, key=len)]
            if k == len(segments) - 1 or segment not in node:
                break
            node = node[segment]
        return found

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest match, or (None, None)."""
        node, best = self.root, None
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if None in node:
                best = self._deepest(node[None], path) or best
        return (best[1], best[0]) if best else (None, None)


def _by_trie(parts: DataFrame, rules: list[UrlRule]) -> DataFrame:
    trie = parts.sparkSession.sparkContext.broadcast(HostPathTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.match
        for host, path in batches:
            yield pd.DataFrame([find(h, p) for h, p in zip(host, path)], columns=["rule", "verdict"], dtype=object)

    return parts.withColumn("found", match("host", "path")).select("page_id", "host", "path", "found.rule", "found.verdict")


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by equi-join. A URL gives a row for each host suffix and each length that a rule's path can have."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    parts = parts.withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("suffix"), (F.size(labels) - i).alias("depth")),
    )
    rows = parts.filter("host <> ''").select("row", "path", F.explode(suffixes).alias("s")).select("row", "path", "s.*")
    rows = rows.join(lengths.withColumnRenamed("host", "suffix"), "suffix").withColumn("n", F.explode("lengths")).filter(F.length("path") >= F.col("n"))
    rows = rows.withColumn("start", F.substring("path", F.lit(1), F.col("n")))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    fits = rows.join(named, ["suffix", "start"])
    best = fits.groupBy("row").agg(F.max(F.struct("depth", "n", F.concat("suffix", "start").alias("rule"), "verdict")).alias("b"))
    return parts.join(best, "row", "left").select("page_id", "host", "path", "b.rule", "b.verdict")


def filter_urls(pages: DataFrame, rules: list[UrlRule] | DataFrame, default: str = "allow", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every URL.

    ``rules``: a list, or a DataFrame of verdict, host, path.
    """
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if isinstance(rules, DataFrame):
        few = rules.select("verdict", "host", "path").limit(max_broadcast + 1)
        small = few.count() <= max_broadcast
        found = _by_trie(parts, [UrlRule(*r) for r in few.collect()]) if small else _by_join(parts, rules)
    elif len(rules) <= max_broadcast:
        found = _by_trie(parts, list(rules))
    else:
        found = _by_join(parts, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
