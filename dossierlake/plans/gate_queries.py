"""Queries on what is cited, asked and decided: aliases as a table, precision of unguarded retrieval, texts to search for, reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grounding, retrieval
from ..operators import rules as R
from ..sources.readers import table
from .catalog import query
from .retrieval_queries import _BM25, K, _bm25


@query(
    "alias_gate",
    """WITH c AS (SELECT DISTINCT l_orderkey, l_partkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
 SELECT l_orderkey, 'part-' || l_partkey AS cited, p_brand AS passage, a.p_brand IS NOT NULL AS authorised FROM c LEFT JOIN a USING (l_orderkey, p_brand)""",
)
def alias_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part that an order cites: it is authorised if the order's first line names a part of the same brand, as brands are passages and parts their aliases."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    cited = lines.select("l_orderkey", F.concat(F.lit("part-"), "l_partkey").alias("cited")).distinct()
    allowed = lines.filter("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("part-"), "l_partkey").alias("id"))
    aliases = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("alias"), F.col("p_brand").alias("passage"))
    return grounding.resolved(cited, allowed, aliases, "l_orderkey")


@query(
    "grounding_precision",
    f"""WITH {_BM25}, r AS (SELECT CASE WHEN item_id % 3 = 0 THEN 'held_out' ELSE 'dev' END AS split, source = 'src' || item_id % 20 AS mine FROM lex JOIN documents USING (doc_id) WHERE rank <= {K})
 SELECT coalesce(split, 'overall') AS split, round(avg(CASE WHEN mine THEN 1.0 ELSE 0.0 END), 4) AS precision FROM r GROUP BY ROLLUP (split)""",
)
def grounding_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents that an index of all tenants returns are of the question's own source."""
    source = table(spark, sf_dir, "documents", "doc_id", "source")
    ranked = _bm25(spark, sf_dir, K).join(source, "doc_id").withColumn("split", F.when(F.col("item_id") % 3 == 0, "held_out").otherwise("dev"))
    return retrieval.grounding_precision(ranked, "split", F.col("source") == F.concat(F.lit("src"), F.col("item_id") % 20))


_FLAGS = {"RULE-INC-01": "o_orderstatus = 'F'", "RULE-TAX-01": "o_orderstatus = 'O'", "RULE-COMP-01": "o_orderkey % 3 = 0", "RULE-ID-01": "o_orderkey % 5 = 0"}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(
    "policy_searches",
    f"""SELECT o_orderkey, array_to_string(list_concat({_LIST(retrieval.ALWAYS_ASKED)}, {', '.join(f"CASE WHEN {_FLAGS.get(rule, 'false')} THEN ['{text}'] ELSE [] END" for rule, text in retrieval.ASKED_IF_FLAGGED.items())}), ' | ') AS searches,
 array_to_string(list_concat({', '.join(f"CASE WHEN {_FLAGS[rule] if rule else 'true'} THEN ['{chunk}'] ELSE [] END" for rule, chunk in retrieval.BACKSTOP)}), ' ') AS cited FROM orders""",
)
def policy_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's findings ask the policies for, and the passages that are cited whatever is found."""
    flag = lambda rule: F.when(F.expr(_FLAGS[rule]), R.FLAG).otherwise(R.PASS)
    found = R.findings(**{rule.replace("-", "_"): flag(rule) for rule in _FLAGS})
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").withColumn("f", found)
    none = F.array().cast("array<string>")
    return orders.select("o_orderkey", F.array_join(retrieval.policy_queries(F.col("f")), " | ").alias("searches"), F.array_join(retrieval.with_backstop(none, F.col("f")), " ").alias("cited"))


@query(
    "review_problems",
    """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'APPROVED' ELSE 'NEEDS_INFO' END AS decision, CASE WHEN o_orderkey % 13 = 0 THEN repeat('n', 5001) ELSE ' ' || left('because', o_orderkey % 8) || ' ' END AS notes,
  o_orderkey % 60 AS n, CASE WHEN o_orderkey % 11 = 0 THEN 'A' ELSE ' A' || o_custkey || ' ' END AS typed, 'A' || o_custkey AS id FROM orders)
 SELECT o_orderkey, CASE WHEN decision IN ('REJECTED', 'NEEDS_INFO') AND length(trim(notes)) < 5 THEN 'notes_too_short' WHEN length(trim(notes)) > 5000 THEN 'notes_too_long' WHEN n > 50 THEN 'too_many_corrections' WHEN trim(typed) <> id THEN 'id_differs' END AS problem FROM r""",
)
def review_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids a decision on each order, if anything does."""
    key, app = F.col("o_orderkey"), F.concat(F.lit("A"), F.col("o_custkey").cast("string"))
    decision = F.when(F.col("o_orderstatus") == "F", "REJECTED").when(F.col("o_orderstatus") == "O", "APPROVED").otherwise("NEEDS_INFO")
    notes = F.when(key % 13 == 0, F.repeat(F.lit("n"), 5001)).otherwise(F.concat(F.lit(" "), F.left(F.lit("because"), (key % 8).cast("int")), F.lit(" ")))
    typed = F.when(key % 11 == 0, "A").otherwise(F.concat(F.lit(" "), app, F.lit(" ")))
    corrections = F.array_repeat(F.lit("x"), (key % 60).cast("int"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", R.review_problem(decision, notes, corrections, typed, app).alias("problem"))


@query("newest_events", """SELECT event_id, user_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 20""")
def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty events with a field of their properties."""
    events = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
