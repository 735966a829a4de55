"""Exact top-k inner products by MaxScore over inverted lists.

Vectors of integers are documents, dimensions are terms, a component is a term's weight. The rows are dealt into shards of
bounded size, the queries into blocks of bounded size; each pair of shard and block is one group of a co-grouped join
(a stated query set against all rows, in blocks). In a shard, every dimension has its postings (weights by document) and
bounds. For a query, terms are ordered by what they can add at most; the terms at the end whose bounds together cannot
lift a document over the current k-th score are non-essential. Essential postings are traversed; the others are probed,
one term at a time, for the documents that remain competitive, while the k-th score rises. The shards' best k merge by rank.

Weights may be negative: a term's contribution counts from the lowest that it makes in the shard, so contributions are
never negative and bounds are safe. Documents that can tie with the k-th score stay competitive, so ties are exact.

Shards and blocks have the same bound, as vectors are copied once a block and queries once a shard: both together move
rows * queries * 2 / 65,536 vectors, the least that groups of such size allow, and one block holds the queries of 6.5 million rows.
Vectors of more than 128 components lie in groups of fewer rows, so that a group's components are bounded too.

Defined results: rows with a null id or vector, or with a null or non-finite component, or an empty vector take no part.
Only vectors of a query's length are its candidates. Rows that repeat an id are candidates each, but never for that
id's query; a repeated query row with the same vector counts once. Scores must fit 63 bits.
Ties go to the smaller id. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, SHARD_LEAST, BLOCK_QUERIES = 65_536, 4_096, 65_536
#: Components of a shard's or a block's vectors (64 MB of longs): fewer rows of longer vectors.
GROUP_VALUES = 8 << 20


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.postings = ids[order], np.ascontiguousarray(vectors[order].T)
        self.low, self.high = self.postings.min(1), self.postings.max(1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but the query's own rows, ties to smaller ids."""
        terms = np.flatnonzero(query)
        least = np.minimum(query * self.low, query * self.high)[terms]
        bound = np.maximum(query * self.low, query * self.high)[terms] - least
        order = np.argsort(-bound, kind="stable")
        terms, least, bound = terms[order], least[order], bound[order]
        rest = np.append(np.cumsum(bound[::-1])[::-1], 0)  # rest[j]: what terms from j on can add
        base = int(least.sum())
        n = len(self.ids)
        # a first k-th score from a few documents
        first = np.flatnonzero(self.ids[: min(n, 64 + k)] != own)
        threshold = -(1 << 62)
        if len(first) >= k:
            threshold = int(np.partition(query @ self.postings[:, first], len(first) - k)[len(first) - k])
        essential = int(np.searchsorted(-(base + rest), -threshold, side="right"))  # from here on base + rest < threshold
        essential = min(max(essential, 1), len(terms))
        got = np.full(n, base, np.int64)
        for j in range(essential):
            got += query[terms[j]] * self.postings[terms[j]] - least[j]
        live = np.flatnonzero((got + rest[essential] >= threshold) & (self.ids != own))
        got = got[live]
        for j in range(essential, len(terms)):
            got = got + query[terms[j]] * self.postings[terms[j]][live] - least[j]
            if len(got) > k:
                threshold = max(threshold, int(np.partition(got, len(got) - k)[len(got) - k]))
                keep = got + rest[j + 1] >= threshold
                live, got = live[keep], got[keep]
        best = np.lexsort((self.ids[live], -got))[:k]
        return self.ids[live[best]], got[best]


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    return column.flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 0), np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """query_id, rank (from 1), id and score; both inputs have a long id and an array<long>, without nulls."""
    count = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(vector_col)), F.lit(0))).first()
    (n, values), (m, asked_values) = count(vectors), count(queries)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n / SHARD_ROWS), math.ceil(values / GROUP_VALUES), min(2 * parallel, math.ceil(n / SHARD_LEAST)))
    blocks = max(1, math.ceil(m / BLOCK_QUERIES), math.ceil(asked_values / GROUP_VALUES))
    one = lambda df: df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"))
    # Rows that repeat an id in different parts of the input go to different shards; the part is fixed by the scan.
    left = one(vectors).withColumn("shard", F.pmod(F.xxhash64("id", F.spark_partition_id()), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = one(queries).distinct().withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(rows) and len(asked):
            shard = Shard(rows.column("id").to_numpy(), _matrix(rows, "v"))
            for own, q in zip(asked.column("id").to_pylist(), _matrix(asked, "v"), strict=True):
                ids, scores = shard.top(q, own, k)
                for to, x in zip(out, (np.full(len(ids), own), ids, scores), strict=True):
                    to.append(x)
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["query_id", "id", "score"])

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v): floor(scale * x) of every component; rows that take no part are left out."""
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & sound).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v")
    )
