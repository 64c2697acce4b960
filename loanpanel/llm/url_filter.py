"""URL filter: a trie over reversed host labels and path segments.

A rule is a host and a path prefix with a verdict. It fits a URL whose host is the rule's
host or one of its subdomains and whose path starts with the rule's path. Of the rules that
fit, the one with the most host labels wins, then the one with the longest path; of an allow
and a block entry for the same host and path, the block entry.

The trie is built on the driver from at most ``max_broadcast_rules`` entries and sent to the
executors. A longer list stays a table: URLs are expanded to their host suffixes and path
prefixes (of the lengths that rules have) and joined with it by key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, ASCII_UPPER, ASCII_UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Nested dictionaries: host labels from the right, then whole path segments, then tails.

    ``tails`` of a path node holds what may start the next segment: the part of a rule's
    path behind its last slash, longest first.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, tail = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            tails = node.setdefault("tails", {})
            if tails.get(tail, ("", "allow"))[1] != "block":
                tails[tail] = (host + path, verdict)
            node["tails"] = dict(sorted(tails.items(), key=lambda x: -len(x[0])))

    @classmethod
    def of(cls, root: dict) -> RuleTrie:
        """A trie with the dictionaries of another one."""
        trie = cls(())
        trie.root = root
        return trie

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the winning rule, None if no rule fits."""
        best, segments, node = None, path.split("/"), self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            best = self._longest(node.get("paths"), segments) or best
        return best

    @staticmethod
    def _longest(node: dict | None, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if node is None:
                break
            for tail, found in node.get("tails", {}).items():
                if segment.startswith(tail):
                    best = found
                    break
            node = node.get("next", {}).get(segment)
        return best


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]],
                id_col: str = "page_id", url_col: str = "url", default: str = "allow",
                max_broadcast_rules: int = 200_000) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A null URL, an empty one and one without ``://`` have an empty host and path, fit no rule
    and get ``default``. Repeated rows are judged each; other columns of ``pages`` are not
    read. Rules with a null field are left out. Without rules every verdict is ``default``.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), RULE_SCHEMA)
    rules = rules.select("host", "path", "verdict").dropna()
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    few = rules.limit(max_broadcast_rules + 1).collect()
    if len(few) > max_broadcast_rules:
        return _by_join(urls, rules, id_col, default)
    # plain dictionaries: a broadcast class would have to be installed on the executors
    sent = spark.sparkContext.broadcast(RuleTrie(tuple(r) for r in few).root)

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = RuleTrie.of(sent.value)
        for hosts, paths in batches:
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    return (urls.withColumn("judged", judge("host", "path"))
            .select(id_col, "host", "path", "judged.rule", "judged.verdict"))


def _by_join(urls: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The same verdicts when the rules are too many to send along."""
    keyed = (rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block over allow
             .withColumnsRenamed({"host": "rule_host", "path": "rule_path"}))
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # at most a URL's length
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.substring(F.col("path"), F.lit(1), n))
    urls = urls.withColumn("row", F.monotonically_increasing_id())
    distinct = urls.select("host", "path").distinct()  # a hot URL is looked up once
    keys = (distinct.withColumn("rule_host", F.explode(suffixes))
            .withColumn("rule_path", F.explode(F.array_distinct(prefixes))))
    order = F.struct(F.size(F.split("rule_host", r"\.")), F.length("rule_path"))
    best = (keys.join(keyed, ["rule_host", "rule_path"]).groupBy("host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("best")))
    return (urls.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
