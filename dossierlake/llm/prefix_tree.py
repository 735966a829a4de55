"""Documents whose word n-gram sets are similar (Jaccard), joined over prefix trees.

A document's set holds its distinct five-word shingles (a text of fewer words gives its whole sequence as one), as
64-bit hashes. Of n shingles, a partner within the threshold shares t = ceil(percent * n / 100) at least.

1. Sets that can't have a partner go. In the order of the hashes, a set's first 2 (n - t) + 1 shingles hold more than
   (n - t') that any partner's first ones hold too, for the smallest n' a partner can have. Shingles that one row alone has among its
   first are counted by sums; what is left tells whether a set stays. Equal sets become one.
2. The rest is ordered globally, rare shingles first (those that one set alone holds are counted, not kept). Linked
   sets share one of their first n - t + 1 shingles; sets that do are candidates, and candidates form groups.
3. Groups are dealt into chunks of about ``chunk`` sets. Each chunk's sets are stored in a prefix tree (a trie whose
   unbranched paths are one edge), common shingles first, so that near copies share long paths. Each set traverses the
   tree: the overlap of a path is summed once for all sets below it, and a subtree is left as soon as the overlap so far
   and what can still follow (the shorter of both remainders) stay under what the sizes below ask for. Subtrees whose
   sets are all in the traversing set's component already are left as well: only what joins components is needed.
4. A group of several chunks also sends its most central set (whose shingles are the most common ones) through each of
   its chunks, which joins the chunks' large components. The sets that are then outside the group's largest component
   traverse the group's other chunks that hold a candidate of theirs. So every candidate pair has met or is known to be
   in one component; a row is a set in a chunk, never a pair.
5. Connected components of the links. All overlaps are of full sets, so nothing is estimated.

Null or empty texts and texts of white space have an empty set and are linked with nothing. Rows with a null id are in
no component (null). Rows that share an id count as one document, linked over any of their texts; repeated rows are
copies. Further columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, counted, maybe_broadcast, scratch
from .near_dup import _lists, _profile, shingle_sets

#: Sets and shared shingles of a chunk, about.
CHUNK, CHUNK_SHINGLES = 256, 1_000_000


def least_shared(n, percent: int):
    """The shingles that a set of n shares with any partner: whole numbers, NumPy or columns."""
    return (n * percent + 99) // 100


def _heads(percent: int):
    """Rows (id, text) to (v, id): each set's first shingles in the order of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, h, begin in shingle_sets(batch.column(1)):
                    n = np.diff(begin)
                    m = np.minimum(n, 2 * (n - least_shared(n, percent)) + 1)
                    off = np.append(0, np.cumsum(m))
                    at = np.arange(off[-1]) - np.repeat(off[:-1] - begin[:-1], m)
                    owner = pa.array(np.repeat(np.arange(b - a), m))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), batch.column(0).slice(a, b - a).take(owner)], ["v", "id"])

    return run


class PrefixTree:
    """Sets of numbers in ascending order, with their full sizes, as a trie with one edge a path."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.sets, self.n, self.percent = [sets[i] for i in self.order], sizes[self.order], percent
        length = np.array([len(s) for s in self.sets], np.int64)
        self.edge, self.depth, self.low, self.high, self.terminal, self.children = [], [], [], [], [], []
        path = [self._node(0, 0, -1)]
        for i, s in enumerate(self.sets):
            shared = self._common(self.sets[i - 1], s) if i else 0
            last = None
            while self.depth[path[-1]] > shared:
                last = path.pop()
                self.high[last] = i
                if self.depth[path[-1]] < shared:  # a branch within the edge
                    path.append(self._node(shared, self.low[last], -1))
                self.children[path[-1]].append(last)
            path.append(self._node(len(s), i, i))
        while path:
            last = path.pop()
            self.high[last] = len(self.sets)
            if path:
                self.children[path[-1]].append(last)
        self.edge = [None] * len(self.depth)
        for node, below in enumerate(self.children):
            for child in below:
                self.edge[child] = self.sets[self.low[child]][self.depth[node] : self.depth[child]]
        self.edge[0] = np.zeros(0, np.int64)
        self.least = [self.n[a:b].min() for a, b in zip(self.low, self.high, strict=True)]
        self.most = [self.n[a:b].max() for a, b in zip(self.low, self.high, strict=True)]
        self.left = [length[a:b].max() - d for a, b, d in zip(self.low, self.high, self.depth, strict=True)]

    def _node(self, depth: int, low: int, terminal: int) -> int:
        for column, value in ((self.depth, depth), (self.low, low), (self.high, 0), (self.terminal, terminal), (self.children, [])):
            column.append(value)
        return len(self.depth) - 1

    @staticmethod
    def _common(x: np.ndarray, y: np.ndarray) -> int:
        k = min(len(x), len(y))
        differs = x[:k] != y[:k]
        return int(differs.argmax()) if differs.any() else k

    def links(self, x: np.ndarray, n: int, held: np.ndarray, component: np.ndarray, own: int, after: int = 0) -> Iterator[int]:
        """Places of linked sets at ``after`` or later that are outside component ``own``; ``held`` marks x, and may be any array over all numbers.

        ``component`` is read anew at each step: the caller may join components while this runs.
        """
        held[x] = True
        fewest, percent = least_shared(n, self.percent), self.percent
        todo = [(0, 0)]
        while todo:
            node, overlap = todo.pop()
            low, high = max(self.low[node], after), self.high[node]
            least = max(self.least[node], fewest)
            if low >= high or self.most[node] < fewest or self.least[node] * percent > n * 100 or (component[low:high] == component[own]).all():
                continue
            edge = self.edge[node]
            if len(edge):
                overlap += np.count_nonzero(held[edge])
                rest = len(x) - np.searchsorted(x, edge[-1], side="right")
            else:
                rest = len(x) if not self.depth[node] else len(x) - np.searchsorted(x, self.sets[self.low[node]][self.depth[node] - 1], side="right")
            if (overlap + min(rest, self.left[node])) * (100 + percent) < percent * (n + least):
                continue
            i = self.terminal[node]
            if i >= after and i >= 0 and component[i] != component[own] and overlap * (100 + percent) >= percent * (n + self.n[i]):
                yield i
            todo += [(child, overlap) for child in self.children[node]]
        held[x] = False


def _within(percent: int):
    """A chunk (x, n, c, probe, vs, dfs) to links (a, b): between its sets that are no probes, and from each probe to them.

    Sets with equal c count as linked already.
    """

    def run(table: pa.Table) -> pa.Table:
        x, n, c, probe = (table.column(i).to_numpy() for i in range(4))
        lists, dfs = _lists(table.column(4)), _lists(table.column(5))
        v, df = np.concatenate(lists), np.concatenate(dfs)
        at = np.lexsort((v, -df.view(np.int64)))  # common ones first
        new = np.append(True, v[at][1:] != v[at][:-1])
        number = np.empty(len(v), np.int64)
        number[at] = np.cumsum(new) - 1
        cuts = np.cumsum([len(s) for s in lists])[:-1]
        sets = [np.sort(s) for s in np.split(number, cuts)]
        held = np.zeros(int(new.sum()), bool)
        kept = np.flatnonzero(~probe)
        found: tuple[list, list] = ([], [])
        if len(kept):
            tree = PrefixTree([sets[i] for i in kept], n[kept], percent)
            inside = kept[tree.order]
            component = np.append(c[inside], 0)
            for own, i in enumerate(inside):
                for j in tree.links(sets[i], n[i], held, component, own, own + 1):
                    component[component == component[j]] = component[own]
                    found[0].append(x[i]), found[1].append(x[inside[j]])
            for i in np.flatnonzero(probe):
                component[-1] = c[i]
                for j in tree.links(sets[i], n[i], held, component, len(component) - 1):
                    component[component == component[j]] = component[-1]
                    found[0].append(x[i]), found[1].append(x[inside[j]])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _joined(chunks: DataFrame, percent: int) -> DataFrame:
    """Links within chunks of rows (g, chunk, x, n, c, probe, vs, dfs)."""
    return chunks.select("x", "n", "c", "probe", "vs", "dfs", "g", "chunk").groupBy("g", "chunk").applyInArrow(_within(percent), "a long, b long")


def _candidates(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets with their shared shingles in the global order, first shingles as (v, x)) of those with enough shared shingles."""
    tokens = sets.select("x", "n", F.explode("vals").alias("v"))
    shared, many = counted(tokens.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1"), "shared")
    held = tokens.join(maybe_broadcast(shared, many), "v").groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"))
    t = F.floor((F.col("n") * percent + 99) / 100)
    kept = held.filter(F.size("s") >= t).select("x", "n", F.col("s.v").alias("vs"), F.transform("s.df", lambda d: d.cast("long")).alias("dfs"))
    ordered = scratch(kept, "ordered")
    return ordered, scratch(ordered.select("x", F.explode(F.slice("vs", F.lit(1), (F.size("vs") - t + 1).cast("int"))).alias("v")), "first")


def set_links(sets: DataFrame, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all linked rows of ``sets`` (x unique, n, vals: n distinct longs)."""
    ordered, first = _candidates(sets, percent)
    low = first.groupBy("v").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).filter("lo < hi").select("v", "lo")
    near = components(first.join(low, "v").filter("x <> lo").select(F.col("x").alias("a"), F.col("lo").alias("b")).distinct())
    at = scratch(ordered.join(near.toDF("x", "g"), "x"), "grouped")
    weight = F.aggregate("dfs", F.lit(0).cast("long"), lambda s, d: s + d) / F.col("n")
    each = at.select("g", F.size("vs").alias("shingles"), F.struct(weight.alias("w"), (-F.col("x")).alias("x")).alias("w"))
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("shingles") / CHUNK_SHINGLES)).cast("int")
    large, many = counted(each.groupBy("g").agg(chunks.alias("chunks"), F.max("w").alias("w")).filter("chunks > 1").select("g", "chunks", (-F.col("w.x")).alias("hub")), "large")
    rows = at.join(maybe_broadcast(large, many), "g", "left").select("*", F.coalesce(F.pmod(F.xxhash64("x"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk"), F.col("x").alias("c"), F.lit(False).alias("probe"))
    if not many:
        return scratch(_joined(rows, percent), "links")
    rows = scratch(rows, "chunks")
    hubs = rows.filter("x = hub").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("other <> chunk").drop("chunk").withColumnRenamed("other", "chunk").withColumn("probe", F.lit(True))
    links = scratch(_joined(rows.unionByName(hubs), percent), "links")
    # what is outside a large group's main component meets the other chunks that hold a candidate of it
    comps = scratch(components(links), "components")
    rows = rows.filter("chunks is not null").drop("c").join(comps.toDF("x", "component"), "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component")
    rows = scratch(rows, "settled")
    main = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size")).groupBy("g").agg(F.max_by("c", F.struct("size", "c")).alias("main"))
    rest, more = counted(rows.join(maybe_broadcast(main, many), "g").filter("c <> main").drop("main"), "rest")
    if not more:
        return links
    entries = first.join(rows.select("x", "g", "chunk", "c"), "x")
    mine = first.join(maybe_broadcast(rest.select("x", "g", "chunk", "c"), more), "x").select("v", "x", "g", F.col("chunk").alias("own"), "c")
    there = entries.groupBy("v", "chunk").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    visits = mine.join(there, "v").filter("chunk <> own and not (lo = hi and lo = c)").select("x", "g", "chunk").distinct()
    visits = scratch(visits, "visits")
    probes = rest.drop("g", "chunk").join(visits, "x").withColumn("probe", F.lit(True))
    visited = rows.join(visits.select("g", "chunk").distinct(), ["g", "chunk"], "left_semi")
    # sets of a visited chunk have met each other: only probes traverse, so no set starts a traversal twice
    return scratch(links.unionByName(_joined(visited.unionByName(probes.select(*visited.columns)), percent)), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id reachable by links."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profile = "id long, n long, sig_a long, sig_b long, vals array<long>"
    base = scratch(texts.mapInArrow(_profile(0, 0), profile).drop("vals"), "profiles")
    some, sig = base.filter("n > 0 and id is not null"), ["n", "sig_a", "sig_b"]
    alone = texts.filter("id is not null").mapInArrow(_heads(percent), "v long, id long").groupBy("v").agg(F.count(F.lit(1)).alias("df"), F.min("id").alias("id")).filter("df = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    t = F.floor((F.col("n") * percent + 99) / 100)
    first = F.least(F.col("n"), 2 * (F.col("n") - t) + 1)
    needed = F.least(F.floor(t * (100 - percent) / 100) + 1, F.floor((t * percent + 99) / 100))  # a partner has t shingles at least
    rows = some.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"))
    stay = rows.join(alone, "id", "left").filter((F.col("rows") > 1) | (first - F.coalesce("alone", F.lit(0)) >= F.least(needed, first)))
    stay, many = counted(stay.select("id", "rows"), "stay")
    left = some.join(maybe_broadcast(stay, many), "id")
    classes = scratch(left.groupBy(*sig).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    ids = counted(classes.select(F.col("node").alias("id")).distinct(), "nodes")
    full = scratch(texts.join(maybe_broadcast(*ids), "id", "left_semi").mapInArrow(_profile(0, 1 << 62), profile).filter("n > 0").withColumn("x", F.monotonically_increasing_id()), "sets")
    one = counted(full.groupBy(*sig).agg(F.min(F.struct("id", "x")).alias("m")).select("m.x"), "sets-once")
    links = set_links(full.join(maybe_broadcast(*one), "x", "left_semi").select("x", "n", "vals"), percent, chunk)
    named = full.select("x", "id")
    links = links.join(named.toDF("a", "id_a"), "a").join(named.toDF("b", "id_b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    several = left.filter("rows > 1").select("id", *sig).distinct().join(classes, sig).select(F.col("id").alias("a"), F.col("node").alias("b"))
    groups = components(links.union(several)).toDF("node", "component_id")
    telling = classes.join(groups, "node", "left").select(*sig, F.coalesce("component_id", "node").alias("component_id"), "node", "copies").filter("copies > 1 or component_id <> node")
    told = base.join(maybe_broadcast(*counted(telling.select(*sig, "component_id"), "telling")), sig, "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"))
