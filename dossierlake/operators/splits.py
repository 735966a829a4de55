"""Splits that share neither of two keys: rows that are linked over either key go to one split together.

Rows tie an applicant to a template family. Linked keys form components of the bipartite graph; a component goes to one split
as a whole. Components of at least a thousandth of all rows, of which there are at most a thousand, are dealt one by one,
the largest first, to the split that lacks most; all smaller ones follow a hash, in shares that fill what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: A component is dealt by its size if it holds at least one of so many rows.
LARGE = 1000


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(side, key, component): components of the graph with an edge a row between a key ``a`` and a key ``b`` (strings); null keys link nothing.

    Every round, each node takes the least label among its neighbours', and then its label's own label, until nothing changes:
    labels jump, so rounds grow with the logarithm of a component's length. Labels are written and read between rounds.
    """
    pairs = _stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.concat(F.lit("a:"), F.col(a).cast("string")).alias("x"), F.concat(F.lit("b:"), F.col(b).cast("string")).alias("y")).distinct(), "pairs")
    both = pairs.union(pairs.select("y", "x")).toDF("x", "y")
    labels = _stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("y", "l"), "y").groupBy("x").agg(F.min("l").alias("near"))
        low = labels.join(near, "x").select("x", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        jumped = low.join(labels.toDF("label", "far"), "label", "left").select("x", "before", F.least("label", F.coalesce("far", "label")).alias("label"))
        now = _stored(jumped, "labels")
        if not now.filter("label <> before").head(1):
            return now.select(F.substring("x", 1, 1).alias("side"), F.substr("x", F.lit(3)).alias("key"), F.col("label").alias("component"))
        labels = now.drop("before")


def double_disjoint(rows: DataFrame, a: str, b: str, shares: dict[str, int], seed: int = 42) -> DataFrame:
    """``rows`` with their split, by shares in percent: no value of ``a`` and none of ``b`` is in two splits.

    Rows with a null key are linked over the other one; rows without either have none (null).
    """
    found = linked(rows, a, b)
    side = lambda s, name: found.filter(F.col("side") == s).select(F.col("key").alias(name), F.col("component").alias(f"_{s}"))
    keyed = rows.withColumns({"_ka": F.col(a).cast("string"), "_kb": F.col(b).cast("string")}).join(side("a", "_ka"), "_ka", "left").join(side("b", "_kb"), "_kb", "left")
    # a key that only stands beside nulls is alone
    own = F.coalesce("_a", "_b", F.concat(F.lit("a:"), "_ka"), F.concat(F.lit("b:"), "_kb"))
    keyed = keyed.withColumn("_component", own).drop("_a", "_b", "_ka", "_kb")
    sizes = _stored(keyed.filter(F.col("_component").isNotNull()).groupBy("_component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lacks = {s: share * total for s, share in shares.items()}
    dealt = []
    for c, n in sizes.filter(F.col("n") * LARGE >= total).orderBy(F.desc("n"), "_component").collect():  # at most LARGE rows
        s = max(lacks, key=lambda x: (lacks[x], -list(shares).index(x)))
        lacks[s] -= 100 * n
        dealt.append((c, s))
    left, at, choice = {s: max(x, 0) for s, x in lacks.items()}, 0, F.lit(None).cast("string")
    whole = sum(left.values()) or 1
    u = F.pmod(F.xxhash64(F.lit(seed), "_component"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    for s in reversed(shares):
        at += left[s]
        choice = F.when(u >= 1 - at / whole, F.coalesce(choice, F.lit(s))).otherwise(choice) if at < whole else F.coalesce(choice, F.lit(s))
    large = rows.sparkSession.createDataFrame(dealt, "_component string, _split string")
    chosen = keyed.join(F.broadcast(large), "_component", "left")
    return chosen.withColumn("split", F.when(F.col("_component").isNotNull(), F.coalesce("_split", choice))).drop("_component", "_split")
