"""Queries over what is kept between runs: a tenant index, a merged table, states, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits, state, tenant_index
from ..sources import versioned
from ..sources.readers import table
from ..sources.shared import shared_path
from .answer_queries import STOP, hybrid_sql
from .catalog import query


@query(
    "tenant_index_search",
    f"""WITH p AS (SELECT source AS part, doc_id AS key, coalesce(text, '') AS text FROM documents WHERE source IS NOT NULL AND (source <> 'src1' OR doc_id % 2 = 0)),
 a AS (SELECT item_id AS q, 'src' || item_id % 20 AS part, text FROM benchmark), {hybrid_sql(5, 15)} SELECT q AS item_id, part AS tenant, key AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM best""",
)
def tenant_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed by source, one source replaced afterwards by fewer documents, and every benchmark item searched in one source."""
    docs, path = table(spark, sf_dir, "documents", "doc_id", "text", "source"), shared_path(spark, "tenants")
    tenant_index.replaced(docs, path, "doc_id", "text", "source")
    tenant_index.replaced(docs.filter("source = 'src1' and doc_id % 2 = 0"), path, "doc_id", "text", "source", tenants=["src1"])
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), F.col("item_id") % 20).alias("tenant"), "text")
    found = tenant_index.search(spark, path, asked, "item_id", "text", 5, stop=STOP)
    return found.select("item_id", "tenant", F.col("key").alias("doc_id"), "score", "rank")


@query(
    "merged_in_batches",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def merged_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, merged from three batches of which one comes twice."""
    orders, path = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), shared_path(spark, "merged")
    for number in (0, 1, 1, 2):
        versioned.merge_batch(orders.filter(F.col("o_orderkey") % 3 == number), number, path, "o_custkey", ["o_orderdate", "o_orderkey"])
    return versioned.latest(spark, path, orders.schema)


@query(
    "state_overlay",
    """WITH s AS (SELECT event_id, props, CASE WHEN event_type = 'error' THEN json_object('k', NULL, 'user', json_object('id', user_id, 'type', event_type)) ELSE json_object('value', value, 'user', json_object('id', user_id, 'since', 2020)) END AS p,
  CASE WHEN event_id % 3 = 0 THEN json_object('user', json_object('since', NULL, 'name', 'n' || user_id), 'k', [1, 2]) END AS q FROM events),
 m AS (SELECT event_id, CASE WHEN q IS NULL THEN json_merge_patch(props, p) ELSE json_merge_patch(json_merge_patch(props, p), q) END AS j FROM s)
 SELECT event_id, j->>'$.k' AS k, CAST(j->>'$.value' AS DOUBLE) AS value, j->>'$.user.id' AS id, j->>'$.user.type' AS type, j->>'$.user.since' AS since, j->>'$.user.name' AS name, CAST(len(json_keys(j)) AS INTEGER) AS keys FROM m""",
)
def state_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's properties with two patches laid over them; nulls take keys away, objects meet key by key."""
    user, kind = F.col("user_id"), F.col("event_type")
    nothing = F.lit(None).cast("string")
    whole = {"ignoreNullFields": "false"}
    error = F.to_json(F.struct(nothing.alias("k"), F.struct(user.alias("id"), kind.alias("type")).alias("user")), whole)
    other = F.to_json(F.struct("value", F.struct(user.alias("id"), F.lit(2020).alias("since")).alias("user")))
    second = F.to_json(F.struct(F.struct(nothing.alias("since"), F.concat(F.lit("n"), user).alias("name")).alias("user"), F.array(F.lit(1), F.lit(2)).alias("k")), whole)
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.when(kind == "error", error).otherwise(other).alias("p"), F.when(F.col("event_id") % 3 == 0, second).alias("q"))
    once = rows.select("event_id", "q", state.overlaid("props", "p", drop_nulls=True).alias("s"))
    j = once.select("event_id", state.overlaid("s", "q", drop_nulls=True).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return j.select("event_id", at("$.k").alias("k"), at("$.value").cast("double").alias("value"), at("$.user.id").alias("id"), at("$.user.type").alias("type"), at("$.user.since").alias("since"), at("$.user.name").alias("name"), F.size(F.json_object_keys("j")).alias("keys"))


SHARES = {"train": 70, "dev": 15, "test": 15}


@query(
    "double_disjoint_splits",
    """WITH RECURSIVE sized AS (SELECT 'a:' || min(CAST(o_custkey AS VARCHAR)) AS c, o_custkey % 97 AS g, count(*) AS n FROM orders GROUP BY 2), ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, c) AS i FROM sized),
 t AS (SELECT count(*) AS total FROM orders), dealt AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS g, CAST(NULL AS VARCHAR) AS split, 70 * total AS a, 15 * total AS b, 15 * total AS c FROM t
 UNION ALL SELECT i, g, s, a - CASE WHEN s = 'train' THEN 100 * n ELSE 0 END, b - CASE WHEN s = 'dev' THEN 100 * n ELSE 0 END, c - CASE WHEN s = 'test' THEN 100 * n ELSE 0 END FROM
  (SELECT r.i, r.g, r.n, d.a, d.b, d.c, CASE WHEN d.a >= d.b AND d.a >= d.c THEN 'train' WHEN d.b >= d.c THEN 'dev' ELSE 'test' END AS s FROM dealt d JOIN ranked r ON r.i = d.i + 1))
 SELECT o_custkey, o_custkey % 97 * 10 + o_orderkey % 10 AS family, split, count(*) AS n FROM orders JOIN dealt ON o_custkey % 97 = g GROUP BY ALL""",
)
def double_disjoint_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and families of orders (which a hash of either would tear apart) dealt to three splits that share neither, with the members."""
    family = F.col("o_custkey") % 97 * 10 + F.col("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select("o_custkey", family.alias("family"))
    return splits.double_disjoint(rows, "o_custkey", "family", SHARES).groupBy("o_custkey", "family", "split").agg(F.count(F.lit(1)).alias("n"))
