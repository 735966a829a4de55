"""Balanced sharding of documents by label propagation, in DataFrame operations only.

Documents are linked when their texts are equal (hash, CRC and size agree). A text's documents start in shards by a hash of id and text, whatever the files' layout;
then, for some rounds, each text's documents vote, and joins move the pieces of a text (its documents in one shard)
towards the shard that holds most of it, which saves the most cut links. Two shards exchange what both send each other,
and beyond that a shard takes in only what its quota has room for; those with the largest gain go first. A text with more than a quarter of a shard's rows is dealt into chunks that move
on their own, so it fills several shards instead of one.

At last the documents in the order (label, text, id) are cut into ranges of equal counts, which is the law ``rows``:
counts are at most one apart. Texts lie together in that order, so the cuts split few of them. Positions come from
counts of bins and row numbers within a bin; bins hold about ``BIN_ROWS`` rows, also within a text of more. The bins' counts
are summed up within buckets of bins, within shards, and over shards, so no task sums up all bins.

Defined results: a null text counts as empty (size 1, CRC 0); null ids are placed like others (their rows' places
depend on the layout); rows that repeat get a slot each; further columns, whatever their names, are ignored; an empty table gives no rows. grown_shard is null, as the law is not ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, maybe_broadcast, scratch

#: The quota may exceed an even share by SLACK while labels move; the last step makes the counts even in any case.
ROUNDS, SLACK, GAIN_STEPS, CELLS, BIN_ROWS = 6, 0.25, 24, 64, 50_000
TEXT = ["g", "crc", "size", "chunk"]


def _hash_mod(n: int | Column, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n) if isinstance(n, int) else n)


def propagate(pieces: DataFrame, fixed: dict[int, int], shards: int, rows: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """Moves pieces (text columns, start, label, n) under quotas; ``fixed``: rows by label that don't move. At most 16 rows of loads and one sum reach the driver."""
    spark = pieces.sparkSession
    quota = int(rows / shards * (1 + slack)) + 1
    for _ in range(rounds):
        load = {r["label"]: r["n"] for r in pieces.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        room = spark.createDataFrame([(s, max(0, quota - load.get(s, 0) - fixed.get(s, 0))) for s in range(shards)], "target int, room long")
        votes = pieces.groupBy(*TEXT, "label").agg(F.sum("n").alias("votes"))
        first = Window.partitionBy(*TEXT).orderBy(F.desc("votes"), F.xxhash64("label", "g"), "label")
        best = votes.withColumn("r", F.row_number().over(first)).filter("r = 1").select(*TEXT, F.col("label").alias("target"), F.col("votes").alias("most"))
        asked = pieces.join(votes, [*TEXT, "label"]).join(best, TEXT).filter("label <> target").withColumn("step", F.least(F.lit(GAIN_STEPS), F.ceil(F.log2(F.col("most") - F.col("votes") + 1))).cast("int"))
        asked = scratch(asked.withColumn("cell", _hash_mod(CELLS, *TEXT, "start").cast("int")), "asked")
        # At most shards * shards * steps * cells rows, so these windows are bounded.
        cells = asked.groupBy("label", "target", "step", "cell").agg(F.sum("n").alias("n"))
        flow = cells.groupBy("label", "target").agg(F.sum("n").alias("out"))
        back = flow.select(F.col("target").alias("label"), F.col("label").alias("target"), F.col("out").alias("back"))
        even = flow.join(back, ["label", "target"], "left").select("label", "target", F.least("out", F.coalesce("back", F.lit(0))).alias("even"))
        upto = lambda *keys: F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("step"), "cell", "label"))
        cells = cells.join(F.broadcast(even), ["label", "target"]).withColumn("swapped", upto("label", "target") <= F.col("even"))
        cells = cells.withColumn("upto", upto("target", "swapped")).join(F.broadcast(room), "target").filter("swapped or upto <= room")
        taken = scratch(cells.select("label", "target", "step", "cell", F.lit(True).alias("taken"), F.col("n").alias("rows")), "taken")
        if not taken.agg(F.sum("rows")).first()[0]:
            break
        moves = asked.join(F.broadcast(taken), ["label", "target", "step", "cell"]).select(*TEXT, "start", "target")
        pieces = scratch(pieces.join(moves, [*TEXT, "start"], "left").select(*TEXT, "start", F.coalesce("target", "label").alias("label"), "n"), "pieces")
    return pieces


def balanced_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g"), F.monotonically_increasing_id().alias("row"))
    # rows of one id and text are the same row to every result, so they may share a number; those without an id need their own
    base = base.withColumn("row", F.when(F.col("id").isNotNull(), F.xxhash64("id", "g")).otherwise(F.xxhash64("row", "g")))
    base = scratch(base.withColumn("start", _hash_mod(shards, "row", "g").cast("int")), "rows")
    total = base.count()
    text_of = ["g", "crc", "size"]
    quarter = max(1, total // (4 * shards))
    groups = base.groupBy(*text_of).agg(F.count(F.lit(1)).alias("n"))
    # texts that fill a bin or more are dealt into parts of about BIN_ROWS rows; there are at most total / BIN_ROWS of them, or 4 * shards
    chunks = F.ceil(F.col("n") / quarter).cast("int")
    parts = F.ceil(F.col("n") / chunks / BIN_ROWS).cast("int")
    large, many = counted(groups.filter(F.col("n") > max(min(quarter, BIN_ROWS), 1)).select(*text_of, chunks.alias("chunks"), parts.alias("parts")), "large")
    rows = base.join(maybe_broadcast(large, many), text_of, "left").withColumn("chunk", F.coalesce(_hash_mod(F.col("chunks"), "row").cast("int"), F.lit(-1)))
    pieces = rows.groupBy(*TEXT, "start").agg(F.count(F.lit(1)).alias("n"))
    linked = pieces.join(pieces.groupBy(*TEXT).agg(F.sum("n").alias("all")).filter("all > 1").select(*TEXT), TEXT, "left_semi")
    linked = scratch(linked.select(*TEXT, "start", F.col("start").alias("label"), "n"), "pieces")
    loads = lambda df, c: {r[0]: r[1] for r in df.groupBy(c).agg(F.sum("n").alias("n")).collect()}  # noqa: E731  one row a shard
    every, moving = loads(base.select("start", F.lit(1).alias("n")), "start"), loads(linked, "label")
    placed = propagate(linked, {s: every.get(s, 0) - moving.get(s, 0) for s in range(shards)}, shards, total, rounds)
    buckets = max(16, -(-total // (shards * BIN_ROWS)))
    labelled = rows.join(placed.select(*TEXT, "start", "label"), [*TEXT, "start"], "left").select(
        "id", "size", "crc", "g", "chunk", "row", F.coalesce("label", "start").alias("label"), _hash_mod(buckets, "g", F.lit(1)).cast("int").alias("bucket"),
        F.when(F.col("chunk") >= 0, F.col("g")).otherwise(0).alias("alone"), F.when(F.col("chunk") >= 0, _hash_mod(F.col("parts"), "row", F.lit(2)).cast("int")).otherwise(-1).alias("part"),
    )
    labelled = scratch(labelled, "labelled")
    order = ["label", "bucket", "alone", "chunk", "part"]
    # prefix sums on three levels, so that no window holds more than a shard's buckets or a bucket's bins
    bins = scratch(labelled.groupBy(*order).agg(F.count(F.lit(1)).alias("n")), "bins")
    upto = lambda by, *at: F.sum("n").over(Window.partitionBy(*by).orderBy(*at)) - F.col("n")
    of_bucket = bins.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    of_label = of_bucket.groupBy("label").agg(F.sum("n").alias("n"))  # one row a shard
    starts = of_bucket.select("label", "bucket", upto(["label"], "bucket").alias("bucket_before")).join(F.broadcast(of_label.select("label", upto([], "label").alias("label_before"))), "label")
    before = bins.withColumn("bin_before", upto(["label", "bucket"], "alone", "chunk", "part")).join(starts, ["label", "bucket"]).select(*order, (F.col("label_before") + F.col("bucket_before") + F.col("bin_before")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*order).orderBy("g", "crc", "size", F.col("id").asc_nulls_first(), "row")) - 1
    joined = labelled.withColumn("within", within).join(before, order)
    shard = F.expr(f"((before + within) * {shards}) div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        joined.withColumn("shard", shard)
        .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("within") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
