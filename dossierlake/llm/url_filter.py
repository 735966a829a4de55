"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and a path, written ``host/path``. It fits the host and all its subdomains, for URLs whose path begins
with the rule's. The longest rule that fits decides (host and path characters counted together; at equal length the
longer host, and block before allow for the very same rule); where none fits, ``default`` does.

The trie's nodes hold children by reversed host label, and from each host node children by path segment; a rule's last,
unfinished segment is kept by its length, so that prefixes within a segment are found without a scan over rules. A
broadcast trie holds at most ``max_rules`` rules. A longer list takes several passes over the URLs, of which each holds
one trie and writes what it found, so neither a broadcast nor a worker's memory grows with the list; a URL's verdict is
the best over the passes.

Defined results: a URL that is null or has no ``://`` has an empty host and path, and no rule fits it. An empty rule
list gives the default. Hosts keep ports and user names as they stand; only A-Z are lower-cased. Repeated URLs are judged
each, very long ones whole; an empty table gives no rows. Columns of the input called host, path, rule or verdict are
replaced by the results, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, unused

MAX_RULES = 200_000
_DOWN = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a URL as text, without decoding."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_DOWN), path[:stop]


class Trie:
    """Rules as (verdict, 'host/path'). Nodes are [children by label, path node]; path nodes [children by segment, {length: {tail: rule}}]."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: list = [{}, None]
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"rule {rule} has the verdict {verdict}")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_DOWN).split(".")):
                node = node[0].setdefault(label, [{}, None])
            node[1] = node[1] or [{}, {}]
            at = node[1]
            *whole, tail = (slash + path).split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            key = (len(rule), len(host), verdict == "block", verdict, rule)
            tails = at[1].setdefault(len(tail), {})
            tails[tail] = max(key, tails.get(tail, key))

    def best(self, host: str, path: str) -> tuple | None:
        """The key of the longest rule that fits."""
        found, node = None, self.root
        if not host:
            return None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            at = node[1]
            for i in range(len(segments) if at else 0):
                # An unfinished tail may end within this segment or, when empty, at its border.
                for length, tails in at[1].items():
                    hit = tails.get(segments[i][:length]) if length <= len(segments[i]) else None
                    if hit and (found is None or hit > found):
                        found = hit
                at = at[0].get(segments[i]) if i + 1 < len(segments) else None
                if at is None:
                    break
        return found


_FOUND = "host string, path string, length int, host_length int, block boolean, verdict string, rule string"


def _judge(trie: Broadcast):
    """The function of a URL that gives its parts and the key of the trie's longest rule that fits."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    @F.pandas_udf(_FOUND)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [split_url(url) for url in batch]
            yield pd.DataFrame([(h, p, *(trie.value.best(h, p) or (None,) * 5)) for h, p in split], columns=names)

    return judge


def judge_urls(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict."""
    sc, new, found = urls.sparkSession.sparkContext, ["host", "path", "rule", "verdict"], unused(urls, "found")
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in new]
    judged = urls
    for i in range(0, max(1, len(rules)), max_rules):
        this = _judge(sc.broadcast(Trie(rules[i : i + max_rules])))(F.col(url_col))
        # structs compare field by field: host and path are equal for one URL, so the rule's length comes first
        judged = judged.withColumn(found, F.greatest(F.col(found), this) if i else this)
        if i + max_rules < len(rules):
            judged = scratch(judged, "judged")
    return judged.select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in new[:3]], F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"))
