"""Near duplicates by bottom-k sketches of one hash function, with exact verification.

A document's set holds its distinct five-word shingles (a text of fewer words gives its whole sequence as one).
Its sketch holds the k smallest hashes of the set; sets of at most ``whole`` shingles are retained entirely, so that
for them every bound below is exact.

1. Documents with equal sets (128-bit signature and size) become one node, whose id is the smallest doc_id.
2. Inverted lists: (retained value, node). Each node enters the lists of its rarest retained values only, as many
   as any partner within the threshold must share one of (prefix filtering). Values that one node retains need no list.
   For two whole sets the overlap that their sizes ask for bounds the ranks that a shared value can have in both.
3. Lists of up to ``pair_up_to`` nodes give their pairs. A longer list gives each node with the list's most central
   node. Lists whose nodes are then in one component are done; the others go on as groups, one for each central node.
4. The union sketch (the k smallest of both) estimates a pair's similarity; pairs more than five standard deviations
   below the threshold go. Both the lists' bound and this one lose a link at the threshold with a probability
   below 1e-5, and more similar ones far less. For nodes retained whole nothing is estimated.
5. The rest are verified on full sets; for nodes that are retained whole the estimate is that verification already.
6. Groups (``_Linker.across``), on full sets. Where all but ``few`` nodes of a group are in one component, those few are
   compared with the others. A larger rest is settled by edits: the shingles that more than half of the group hold are
   its centre, and a node's edits are what it holds beside the centre or lacks of it. Edits tell distances: two nodes
   differ in the sum of their edits less twice those they share. So two nodes whose edits are few enough are linked
   without a look at their sets, and one row for each node (with the node nearest to the centre) states all those links.
   Where at most ``most`` nodes are then outside the largest component, these are compared with all members, block by
   block within tasks, so a node's rows are as many as the other side's blocks. In larger rests two nodes must share edits, as many as their numbers ask for, and meet in inverted lists of their rarest edits.
   Each such list holds at most half of the group and is a group of the next round, so rounds end by halving. An edit's
   rank bounds what two nodes can share from there on, which leaves out most of a list's pairs.
   No step makes a row for each pair of a group: rows are nodes, shingles, or at most ``few`` partners a node.
7. Connected components of the links.

Defined results: null or empty texts and texts of white space have an empty set, are linked with nothing, and stay.
Rows with a null id stay in no component (null) and are kept. Rows that share an id count as one document, linked
over any of their texts. Repeated rows are copies. Ties between nodes are broken by the smaller id. Further columns of
the input, whatever their names, are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as tn
from .common import BROADCAST_ROWS, components, counted, forget, maybe_broadcast, merged, scratch

SIGMAS = 5
#: Keeps the lists of sketches apart from those of whole sets.
OTHER_FAMILY = 0x5DEECE66D
#: Parts of the retained values, by their last two bits, that are shuffled one after the other, so that only one part's shuffle takes disk at a time.
SLICES = 4
#: Nodes of a block (as many as BLOCK of at most EDITS_A_NODE edits each): a task compares two blocks at a time.
BLOCK, EDITS_A_NODE = 256, 512


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, distinct hashes of each text in ascending order, borders), slice by slice."""
    for a, b, data, off in tn.slices(texts):
        data = tn.LOWER[data]
        starts, ends, first = tn.word_bounds(data, off)
        yield a, b, *tn.distinct(*tn.shingles(tn.word_hashes(data, starts, ends), first))


def _profile(k: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, h, begin in shingle_sets(batch.column(1)):
                    n = np.diff(begin)
                    pad = np.append(h, np.uint64(0))
                    sums = []
                    for salt in (1, 2):
                        x = tn.mix(pad ^ tn.PLACE[40 + salt])
                        c = np.zeros(len(x) + 1, np.uint64)
                        np.cumsum(x, out=c[1:])
                        sums.append((c[begin[1:]] - c[begin[:-1]]).view(np.int64))
                    m = np.where(n <= whole, n, np.minimum(n, k))
                    off = np.zeros(len(n) + 1, np.int64)
                    np.cumsum(m, out=off[1:])
                    at = np.arange(off[-1]) - np.repeat(off[:-1] - begin[:-1], m)
                    vals = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(h[at].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), vals], ["id", "n", "sig_a", "sig_b", "vals"])

    return run


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            for a, b, h, begin in shingle_sets(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))], ["id", "vals"])


def _lists(col) -> list[np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[off[i] : off[i + 1]] for i in range(len(col))]


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - len(np.unique(np.concatenate([x, y])))


def _judge(percent: int, k: int, whole: int):
    """Rows (a, b, n_a, n_b, vals_a, vals_b) to (a, b, sure) for pairs that stay: sure if both were retained whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tau = percent / 100
        least = k * tau - SIGMAS * math.sqrt(k * tau * (1 - tau))
        for batch in batches:
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            keep, sure = np.zeros(len(batch), bool), (na <= whole) & (nb <= whole)
            for i, (x, y) in enumerate(zip(_lists(batch.column(4)), _lists(batch.column(5)), strict=True)):
                if sure[i]:
                    both = _shared(x, y)
                    keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
                else:
                    x, y = x[:k], y[:k]
                    union = np.unique(np.concatenate([x, y]))
                    top = union[: min(k, len(union))][-1]
                    both = _shared(x[x <= top], y[y <= top])
                    keep[i] = both >= least
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sure[keep])], ["a", "b", "sure"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)):
                both = _shared(x, y)
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, size, vals) to (g, size, v, df): how many of a batch's rows of a group hold each value."""
    for batch in batches:
        group, at, place = np.unique(batch.column(0).to_numpy(), return_index=True, return_inverse=True)
        lists = _lists(batch.column(2))
        v, of = np.concatenate([np.zeros(0, np.uint64), *lists]), np.repeat(place, [len(x) for x in lists])
        order = np.lexsort((v, of))
        v, of = v[order], of[order]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (of[1:] != of[:-1]))) if len(v) else np.zeros(0, np.int64)
        df, g, size = np.diff(np.append(first, len(v))), group[of[first]], batch.column(1).to_numpy()[at][of[first]]
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(size), pa.array(v[first].view(np.int64)), pa.array(df)], ["g", "size", "v", "df"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, id, c, n, vals, centre) to (g, id, c, n, edits): what either array holds and the other does not."""
    for batch in batches:
        found = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(_lists(batch.column(4)), _lists(batch.column(5)), strict=True)]
        off = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=off[1:])
        edits = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], edits], ["g", "id", "c", "n", "edits"])


def _shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each array of x shares with each of y, by products of incidence matrices of a bounded number of columns."""
    flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in (x, y)]
    row = [np.repeat(np.arange(len(side)), [len(z) for z in side]) for side in (x, y)]
    both, found = np.intersect1d(*flat), np.zeros((len(x), len(y)), np.int64)
    at = [np.searchsorted(both, f) for f in flat]
    held = [(a < len(both)) & (both[np.minimum(a, len(both) - 1)] == f) if len(both) else np.zeros(len(f), bool) for a, f in zip(at, flat, strict=True)]
    for low in range(0, len(both), 4096):
        parts = []
        for a, r, h, side in zip(at, row, held, (x, y), strict=True):
            of = h & (a >= low) & (a < low + 4096)
            part = np.zeros((len(side), min(4096, len(both) - low)), np.float32)
            part[r[of], a[of] - low] = 1
            parts.append(part)
        found += (parts[0] @ parts[1].T).astype(np.int64)
    return found


def _across_blocks(percent: int):
    """Of one block of a group's rest and one of its members: links that connect all components that any of their links do, at most one a node."""

    def run(rows: pa.Table) -> pa.Table:
        x, y = (rows.filter(pc.equal(rows["rest"], side)) for side in (True, False))
        ids, comps, sizes = ([side[c].to_numpy() for side in (x, y)] for c in ("id", "c", "n"))
        edits = [_lists(side["edits"]) for side in (x, y)]
        e = [np.array([len(z) for z in side], np.int64) for side in edits]
        apart = e[0][:, None] + e[1][None, :] - 2 * _shared_counts(*edits)
        both = (sizes[0][:, None] + sizes[1][None, :] - apart) // 2
        i, j = np.nonzero((100 * both >= percent * (both + apart)) & (comps[0][:, None] != comps[1][None, :]))
        _, first = np.unique(np.stack([comps[0][i], comps[1][j]]), axis=1, return_index=True)
        above, a, b = {}, [], []

        def top(c: int) -> int:
            while c in above:
                c = above[c]
            return c

        for k in first.tolist():
            low, high = sorted((top(int(comps[0][i[k]])), top(int(comps[1][j[k]]))))
            if low != high:
                above[high] = low
                pair = sorted((int(ids[0][i[k]]), int(ids[1][j[k]])))
                a.append(pair[0])
                b.append(pair[1])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs with both sides' columns, joined by id."""
    x = sets.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    y = sets.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    return pairs.join(x, "a").join(y, "b").select("a", "b", *[f"{c}_{s}" for c in extra for s in "ab"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


class _Linker:
    """Verifies pairs of nodes, and finds the links within groups; holds the sets that both need."""

    def __init__(self, texts: DataFrame, reps: DataFrame, percent: int, k: int, whole: int, few: int, most: int):
        self.texts, self.reps, self.percent, self.k, self.whole, self.few, self.most = texts, reps, percent, k, whole, few, most

    def fits(self, x: Column, y: Column) -> Column:
        """Whether sizes alone allow a link."""
        return F.greatest(x, y) * self.percent <= F.least(x, y) * 100

    def full(self, ids: DataFrame) -> DataFrame:
        """(id, vals) of the given nodes that were not retained whole, from their texts."""
        return self.texts.join(ids, "id", "left_semi").mapInArrow(_full, "id long, vals array<long>").filter(F.size("vals") > self.whole)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        spark = self.reps.sparkSession
        some = scratch(self.reps.join(maybe_broadcast(*counted(_ends(pairs), "ends")), "id", "left_semi"), "candidates")
        kept, _, unsure = counted(_with_sets(pairs, some, ["n", "vals"]).mapInArrow(_judge(self.percent, self.k, self.whole), "a long, b long, sure boolean"), "estimated", F.count_if(~F.col("sure")))
        forget(spark, some)
        if not unsure:
            return kept.select("a", "b")
        unsure = kept.filter("not sure").select("a", "b")
        ends, many = counted(_ends(unsure), "ends")
        sets = scratch(self.texts.join(maybe_broadcast(ends, many), "id", "left_semi").mapInArrow(_full, "id long, vals array<long>"), "sets")
        out = scratch(kept.filter("sure").select("a", "b").union(_with_sets(unsure, sets, ["vals"]).mapInArrow(_verify(self.percent), "a long, b long")).distinct(), "links")
        forget(spark, sets)
        return out

    def across(self, groups: DataFrame, links: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links and components (node, component), once all pairs within the groups (g, id, s, left) are settled.

        Where s and left are not null, two nodes of a group can only be linked if their s add up to what left allows.
        """
        spark, sets = self.reps.sparkSession, None
        while True:
            at = scratch(groups.join(comps.withColumnRenamed("node", "id"), "id", "left").select("g", "id", "s", "left", F.coalesce("component", "id").alias("c")), "members")
            parts = at.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"))
            whole = parts.groupBy("g").agg(F.sum("size").alias("size"), F.max(F.struct("size", -F.col("c"))).alias("x")).select("g", "size", (-F.col("x.col2")).alias("big"), (F.col("size") - F.col("x.size")).alias("minor"))
            whole, some, many = counted(whole.filter("minor > 0"), "groups", F.count_if(F.col("minor") > self.few))
            if not some:
                return links, comps
            at, new = at.join(maybe_broadcast(whole, some), "g"), None
            if some > many:
                mine = at.filter(F.col("minor") <= self.few)
                rest = mine.filter("c <> big").select("g", F.col("id").alias("x"), F.col("c").alias("c_x"), F.col("s").alias("s_x"), F.col("left").alias("left_x"))
                room = F.coalesce(F.col("s") + F.col("s_x") <= 2 * (100 + self.percent) * F.least("left", "left_x"), F.lit(True))
                pairs = mine.select("g", "id", "c", "s", "left").join(rest, "g").filter((F.col("c") != F.col("c_x")) & room)
                pairs, found = counted(pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct(), "pairs")
                new = self.linked(pairs) if found else None
            if many:
                at = scratch(at.filter(F.col("minor") > self.few).select("g", "id", "c", "size").distinct(), "members")
                if sets is None:
                    one = maybe_broadcast(*counted(at.select("id").distinct(), "ends"))
                    kept = self.reps.filter(F.col("n") <= self.whole).select("id", "vals").join(one, "id", "left_semi")
                    sets = scratch(kept.unionByName(self.full(one)).withColumn("n", F.size("vals").cast("long")), "sets")
                near, groups = self.by_edits(spark, at, sets)
                new = near if new is None else new.unionByName(near)
            new, found = counted(new, "links") if new is not None else (None, 0)
            if found:
                links, comps = links.unionByName(new), scratch(merged(comps, new), "components")
            if not many or groups is None:
                return links, comps

    def by_edits(self, spark: SparkSession, at: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """For members (g, id, c, size): links with the node nearest to each group's centre and within groups of a bounded rest, and the other groups' lists of shared edits as groups (g, id, s, left), if there are any."""
        up, down = 100 + self.percent, 100 - self.percent
        held = at.join(sets, "id")
        counts = held.select("g", "size", "vals").mapInArrow(_tally, "g long, size long, v long, df long").groupBy("g", "size", "v").agg(F.sum("df").alias("df"))
        centre = counts.filter("2 * df > size").groupBy("g").agg(F.array_sort(F.collect_list("v")).alias("centre"))  # as long as twice its nodes' sets
        centre, _, much = counted(centre, "centres", F.sum(F.size("centre")))
        much = much or 0
        held = held.select("g", "id", "c", "n", "vals").join(maybe_broadcast(centre, much), "g", "left")
        empty = F.array().cast("array<long>")
        edits = held.withColumn("centre", F.coalesce("centre", empty)).mapInArrow(_edits, "g long, id long, c long, n long, edits array<long>")
        edits = scratch(edits.withColumn("s", up * F.size("edits") - down * F.col("n")).withColumn("row", F.monotonically_increasing_id()), "edits")
        first = counted(edits.groupBy("g").agg(F.min(F.struct("s", "id", "c")).alias("x")).select("g", F.col("x.s").alias("s0"), F.col("x.id").alias("id0"), F.col("x.c").alias("c0")), "first")
        edits = edits.join(maybe_broadcast(*first), "g")
        near = edits.filter("s + s0 <= 0 and id <> id0").select(F.least("id", "id0").alias("a"), F.greatest("id", "id0").alias("b")).distinct()
        # those that are now in the nearest node's component need no list with each other
        own = edits.withColumn("c", F.when(F.col("s") + F.col("s0") <= 0, F.col("c0")).otherwise(F.col("c")))
        weight = F.greatest(F.size("edits"), F.lit(EDITS_A_NODE))
        parts = own.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size"), F.sum(weight).alias("weight"))
        parts = parts.groupBy("g").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.max(F.struct("size", "weight", "c")).alias("x")).filter("size > x.size")
        blocks = lambda w: F.ceil(w / F.lit(float(BLOCK * EDITS_A_NODE)))
        parts = parts.select("g", F.col("x.c").alias("big"), (F.col("size") - F.col("x.size")).alias("minor"), blocks(F.col("weight") - F.col("x.weight")).alias("down"), blocks(F.col("weight")).alias("along"))
        parts, some, large = counted(parts, "parts", F.count_if(F.col("minor") > self.most))
        if some > large:
            near = near.unionByName(self.by_blocks(own.select("g", "id", "c", "n", "edits").join(maybe_broadcast(parts.filter(F.col("minor") <= self.most), some - large), "g")))
        if not large:
            return near, None
        own = own.join(maybe_broadcast(parts.filter(F.col("minor") > self.most).select("g"), large), "g")
        each = own.select("g", "row", "id", "c", "s", "s0", F.size("edits").alias("e"), F.explode("edits").alias("w"))
        lists = each.groupBy("g", "w").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("g", "w", "df")
        by_row = Window.partitionBy("row")
        ranked = each.join(lists, ["g", "w"]).withColumn("shared", F.count(F.lit(1)).over(by_row)).withColumn("rank", F.row_number().over(by_row.orderBy("df", "w")) + F.col("e") - F.col("shared"))
        # a partner's s is s0 at least, and more than -s, else the two are linked already
        least = F.greatest(F.lit(1), F.ceil((F.col("s") + F.greatest("s0", 1 - F.col("s"))) / F.lit(2.0 * up)))
        return near, ranked.filter(F.col("rank") <= F.col("e") - least + 1).select(F.xxhash64("g", "w").alias("g"), "id", "s", (F.col("e") - F.col("rank") + 1).alias("left"))


    def by_blocks(self, at: DataFrame) -> DataFrame:
        """Links between each group's rest, the nodes outside its largest component, and all its members; both are dealt in blocks, and a task has one of each at a time."""
        deal = lambda many, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(many))
        every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
        rest = at.filter("c <> big").withColumn("i", deal("down", 1)).withColumn("j", every("along")).withColumn("rest", F.lit(True))
        members = at.withColumn("j", deal("along", 2)).withColumn("i", every("down")).withColumn("rest", F.lit(False))
        columns = ["g", "i", "j", "rest", "id", "c", "n", "edits"]
        return rest.select(*columns).union(members.select(*columns)).groupBy("g", "i", "j").applyInArrow(_across_blocks(self.percent), "a long, b long").distinct()


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 128, whole: int = 512, pair_up_to: int = 16, few: int = 64, most: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(profiles of the rows, nodes, links between nodes, components as node and component); see the module's text.

    The links connect all that is linked; where a component is known, not all links within it are listed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kept = scratch(texts.mapInArrow(_profile(k, whole), "id long, n long, sig_a long, sig_b long, vals array<long>").withColumn("row", F.monotonically_increasing_id()), "retained")
    base = scratch(kept.drop("vals"), "profiles")
    some = base.filter("n > 0 and id is not null")
    nodes = scratch(some.groupBy("n", "sig_a", "sig_b").agg(F.min("id").alias("node"), F.min_by("row", F.struct("id", "row")).alias("row"), F.count(F.lit(1)).alias("copies")), "nodes")
    copies, many = counted(some.join(nodes.filter("copies > 1").select("n", "sig_a", "sig_b", F.col("row").alias("first")), ["n", "sig_a", "sig_b"]).filter("row <> first").select("row"), "copies")
    reps = kept.filter("n > 0 and id is not null").join(maybe_broadcast(copies, many), "row", "left_anti").select("id", "n", "vals")
    if many > BROADCAST_ROWS:
        reps = scratch(reps, "sketches")
        forget(spark, kept)

    tau = percent / 100
    p_sketch = k - max(1, math.floor(k * tau - SIGMAS * math.sqrt(k * tau * (1 - tau)))) + 1
    n = F.col("n")
    # sizes of sketches are negative; values that one node retains go before the other columns are shuffled
    in_whole = reps.filter(n <= whole).select("id", n.cast("int").alias("n"), F.explode("vals").alias("v"))
    in_sketch = reps.filter(n * 100 > whole * percent).select("id", (-n).cast("int").alias("n"), F.explode(F.slice("vals", 1, k)).alias("v")).withColumn("v", F.col("v").bitwiseXOR(F.lit(OTHER_FAMILY)))
    held = in_whole.union(in_sketch)
    met = [F.col("v").bitwiseAND(F.lit(SLICES - 1)) == i for i in range(SLICES)]
    met = [scratch(some.join(some.groupBy("v").agg(F.count(F.lit(1)).cast("int").alias("df")).filter("df > 1"), "v"), "shared") for some in map(held.filter, met)]
    met = reduce(DataFrame.unionByName, met)
    by_node = Window.partitionBy("id", F.signum("n"))
    size = F.abs("n")
    prefix = F.when(n > 0, n - F.floor((n * percent + 99) / 100) + 1).otherwise(p_sketch)  # ceil(tau * n) in whole numbers
    retained = F.when(n > 0, n).otherwise(F.least(size, F.lit(k)))
    entries = scratch(
        met.withColumn("shared", F.count(F.lit(1)).over(by_node)).withColumn("weight", F.sum("df").over(by_node)).withColumn("rank", F.row_number().over(by_node.orderBy("df", "v")))
        .withColumn("rank", F.col("rank") + retained - F.col("shared")).filter(F.col("rank") <= prefix)
        .select("v", "id", size.alias("n"), F.when(n > 0, F.col("rank")).alias("rank"), (F.col("weight") / retained).alias("weight")),
        "entries",
    )
    forget(spark, met)
    lists, _, longs = counted(entries.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("weight", -F.col("id"), "n")).alias("x")).filter("size > 1").select("v", "size", (-F.col("x.col2")).alias("hub"), F.col("x.n").alias("hub_n")), "lists", F.count_if(F.col("size") > pair_up_to))
    linker = _Linker(texts, reps, percent, k, whole, few, most)

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.select("v", F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "rank")])

    def may_link() -> Column:
        """Sizes within the threshold, and in whole sets (rank is null for sketches) ranks that leave room for the overlap."""
        n_a, n_b = F.col("n_a"), F.col("n_b")
        overlap = F.floor(((n_a + n_b) * percent + 99 + percent) / (100 + percent))
        room = (F.col("rank_a") + overlap <= n_a + 1) & (F.col("rank_b") + overlap <= n_b + 1)
        return (F.col("a") < F.col("b")) & linker.fits(n_a, n_b) & F.coalesce(room, F.lit(True))

    mine = entries.join(lists.filter(F.col("size") <= pair_up_to).select("v"), "v")
    short = side(mine, "a").join(side(mine, "b"), "v").filter(may_link()).select("a", "b")
    long_lists = lists.filter(F.col("size") > pair_up_to)
    spokes = entries.join(maybe_broadcast(long_lists, longs), "v").filter((F.col("id") != F.col("hub")) & linker.fits(F.col("n"), F.col("hub_n"))).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    links = linker.linked(scratch(short.union(spokes).distinct(), "pairs"))
    comps = scratch(components(links), "components")
    if longs:
        # lists with different components go on, under their central node
        at = entries.join(maybe_broadcast(long_lists.select("v", "hub"), longs), "v").select("v", "hub", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("v", "hub", "id", F.coalesce("component", "id").alias("c"))
        at = scratch(at, "members")
        split = counted(at.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("v"), "split")
        null = F.lit(None).cast("long")
        if split[1]:
            groups = at.join(maybe_broadcast(*split), "v").select(F.col("hub").alias("g"), "id").distinct()
            links, comps = linker.across(groups.select("g", "id", null.alias("s"), null.alias("left")), links, comps)
    return base, nodes, links, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, **how) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id and kept (the id is its component's smallest)."""
    base, nodes, _, comps = similarity_links(docs, id_col, text_col, percent, **how)
    groups = comps.withColumnRenamed("component", "component_id")
    # Only nodes with copies or links, or whose id others share, tell more than the row itself.
    telling = scratch(nodes.join(groups, "node", "left").select("n", "sig_a", "sig_b", F.coalesce("component_id", "node").alias("component_id"), "node", "copies").filter("copies > 1 or component_id <> node"), "classes")
    rows = base.select("id", "n", "sig_a", "sig_b").join(telling.select("n", "sig_a", "sig_b", "component_id"), ["n", "sig_a", "sig_b"], "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))
