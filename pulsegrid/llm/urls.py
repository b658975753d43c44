"""Allow and block lists for URLs as a trie over reversed host labels and path segments.

The entries are a configuration list.  Tries are broadcast, each of at most ``bound`` entries;
a longer list is cut into several tries, whose longest match is kept, so that no list is too long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of one broadcast trie; at about 1 KB each, at most 50 MB.
BOUND = 50_000
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there to ``?``, ``#`` or the end.  Null and a url without ``://`` have empty ones."""
    url = F.coalesce(url, F.lit(""))
    part = lambda k: F.regexp_extract(url, "(?s)^.*?://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), UPPER, LOWER), part(2)


class Node:
    """``labels`` by host label, ``segments`` by whole path segment, ``ends`` by the beginnings of
    a last segment; ``rule``: the entry that ends here, as (rank, text, verdict)."""

    __slots__ = ("labels", "segments", "ends", "rule")

    def __init__(self):
        self.labels, self.segments, self.ends, self.rule = {}, {}, {}, None


def build(rules: Sequence[Rule]) -> Node:
    """Trie of (verdict, host, path) entries.  Rank: host labels, then length of the path, then
    block before allow for the same place."""
    root = Node()
    for verdict, host, path in rules:
        host, path = host.translate(str.maketrans(UPPER, LOWER)), path or "/"
        node = root
        labels = host.split(".")[::-1] if host else []
        for label in labels:
            node = node.labels.setdefault(label, Node())
        rank = (len(labels), len(path), verdict == "block")
        *whole, last = path.split("/")[1:]
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        found = node.ends.setdefault(last, (rank, f"{host}{path}", verdict))
        if rank > found[0]:
            node.ends[last] = (rank, f"{host}{path}", verdict)
    return root


def longest(root: Node, host: str, path: str) -> tuple | None:
    """The entry of the highest rank whose host is the url's or above it, and whose path the url's begins with."""
    best, node = None, root
    labels = host.split(".")[::-1] if host else []
    for depth in range(len(labels) + 1):
        if depth:
            node = node.labels.get(labels[depth - 1])
            if node is None:
                break
        at = node
        for segment in path.split("/")[1:] if path.startswith("/") else ():
            for n in range(len(segment) + 1) if at.ends else ():
                rule = at.ends.get(segment[:n])
                if rule and (best is None or rule[0] > best[0]):
                    best = rule
            at = at.segments.get(segment)
            if at is None:
                break
    return best


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", bound: int = BOUND) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of (page_id, url).

    Where no entry fits, rule is null and the verdict is ``default``.  A path that is empty begins
    with no entry's path.  Repeated rows are judged each; other columns are ignored; entries with an
    empty host fit every host."""
    for verdict, _, path in rules:
        if verdict not in ("allow", "block") or not (path == "" or path.startswith("/")):
            raise ValueError(f"not an entry: {verdict} {path}")
    spark = pages.sparkSession
    tries = [spark.sparkContext.broadcast(build(rules[i:i + bound])) for i in range(0, len(rules), bound)]

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        roots = [t.value for t in tries]
        for hosts, paths in batches:
            found = [max((m for m in (longest(r, h, p) for r in roots) if m), default=(None, None, default))
                     for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [m[1] for m in found], "verdict": [m[2] for m in found]}, dtype=object)

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    return (parts.withColumn("m", match("host", "path"))
            .select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("verdict")))
