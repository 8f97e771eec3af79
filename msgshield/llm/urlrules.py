"""URL allow and block rules: a trie over reversed host labels, then path segments.

A rule is a host and a path prefix. The trie is walked along the URL's host labels
from the right; at each host node the path rules below it are walked segment by
segment. The longest rule that fits wins (by characters of host and path); of an
allow and a block rule of the same text, block wins. No rule: the default verdict.

The rules are a list given by the caller. Tries hold at most ``max_rules`` rules, a
bound on every broadcast; a longer list is cut into several tries, each
broadcast and walked on its own, and the longest match of all counts.

Defined results: a null URL, or one without ``://``, has empty host and path
and fits no rule; a URL without path fits no rule, as every rule path starts
with ``/``; labels are compared as they are (ports and user names included).
"""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MAX_RULES = 200_000
ALLOW, BLOCK = "allow", "block"
DEFAULT_RULES = (          # fixed values of the query
    ("net", "/", BLOCK),
    ("example.net", "/en/", ALLOW),
    ("example.com", "/de/", BLOCK),
    ("org", "/fr/", ALLOW),
)


def url_host(url: Column) -> Column:
    part = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(part, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Host labels from the right, then path segments that end in ``/``."""

    def __init__(self, rules):
        self.root = self._node()
        for host, path, action in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["labels"].setdefault(label, self._node())
            node = node["path"]
            *whole, rest = path.split("/")
            for segment in whole:
                node = node["segments"].setdefault(segment, {"segments": {}, "rules": {}})
            self._add(node["rules"], rest, (len(host) + len(path), action == BLOCK, host + path, action))

    @staticmethod
    def _node():
        return {"labels": {}, "path": {"segments": {}, "rules": {}}}

    @staticmethod
    def _add(rules, rest, rule):
        rules[rest] = max(rules.get(rest, rule), rule)

    @staticmethod
    def _path_rules(node, path):
        parts = path.split("/")
        for i, part in enumerate(parts):
            for rest, rule in node["rules"].items():   # what a rule has after its last slash
                if part.startswith(rest):
                    yield rule
            if i + 1 == len(parts) or part not in node["segments"]:
                return
            node = node["segments"][part]

    def match(self, host: str, path: str):
        """``(length, block first, text, action)`` of the best rule, or None."""
        node, best = self.root, None
        labels = host.split(".")
        while node is not None:
            for rule in self._path_rules(node["path"], path):
                best = rule if best is None else max(best, rule)
            node = node["labels"].get(labels.pop()) if labels else None
        return best


def judge_urls(pages: DataFrame, rules=DEFAULT_RULES, default: str = ALLOW, url_col: str = "url",
               max_rules: int = MAX_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row."""
    sc = pages.sparkSession.sparkContext
    rules = list(rules)
    df = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    best = F.lit(None).cast("struct<length:int,block:boolean,rule:string,verdict:string>")
    for at in range(0, len(rules), max_rules):
        best = F.greatest(best, _matcher(sc.broadcast(RuleTrie(rules[at:at + max_rules])))("host", "path"))
    return (df.withColumn("_best", best)
              .withColumn("rule", F.col("_best.rule"))
              .withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best"))


def _matcher(trie):
    @F.pandas_udf("struct<length:int,block:boolean,rule:string,verdict:string>")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        walk = trie.value.match
        return pd.DataFrame([walk(h, p) or (None,) * 4 for h, p in zip(host, path)],
                            columns=["length", "block", "rule", "verdict"]).astype(object)
    return match
