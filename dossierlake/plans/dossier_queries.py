"""Queries over the small steps around a dossier, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossier as D
from ..operators import workqueue as W
from ..sources.readers import table
from .catalog import query


@query("image_coverage", "SELECT l_orderkey, round(greatest(0.0, least(1.0, sum(l_quantity * 10 * l_linenumber * 20) / (612.0 * 792.0))), 6) AS coverage FROM lineitem GROUP BY 1")
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a page, its lines as images on it."""
    images = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") * 10).alias("x1"), (F.col("l_linenumber") * 20.0).alias("y1"), F.lit(612.0 * 792.0).alias("area"))
    return D.image_coverage(images, ["l_orderkey"], "x0", "y0", "x1", "y1", "area").select("l_orderkey", F.round("coverage", 6).alias("coverage"))


@query(
    "route_labels",
    """WITH p AS (SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 OR l_linenumber % 4 = 0 THEN 'pymupdf_native' WHEN l_linenumber % 4 = 1 AND l_orderkey % 5 = 0 THEN 'textract_managed' WHEN l_linenumber % 4 = 2 THEN 'paddleocr_cpu' ELSE 'tesseract_cpu' END AS m FROM lineitem)
 SELECT l_orderkey, CASE WHEN bool_and(m = 'pymupdf_native') THEN 'native' WHEN bool_or(m = 'textract_managed') THEN 'textract' WHEN bool_or(m = 'paddleocr_cpu') THEN 'paddle' ELSE 'ocr' END AS route FROM p GROUP BY 1""",
)
def route_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents whose pages were read in several ways."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    method = F.when((k % 3 == 0) | (n % 4 == 0), "pymupdf_native").when((n % 4 == 1) & (k % 5 == 0), "textract_managed").when(n % 4 == 2, "paddleocr_cpu").otherwise("tesseract_cpu")
    return D.route_labels(table(spark, sf_dir, "lineitem").select("l_orderkey", method.alias("method")), "l_orderkey", "method")


@query(
    "evidence_boxes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity / 100.0 ELSE l_quantity * 10.0 END AS x0, CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber / 10.0 ELSE l_linenumber * 90.0 END AS y0, l_orderkey % 4 = 0 AS small, CASE WHEN l_orderkey % 4 = 1 THEN 612.0 END AS w, CASE WHEN l_orderkey % 4 = 1 THEN 792.0 END AS h FROM lineitem),
 c AS (SELECT *, CASE WHEN small THEN x0 + 0.2 ELSE x0 + 30 END AS x1, CASE WHEN small THEN y0 + 0.001 ELSE y0 + 2 END AS y1 FROM b),
 d AS (SELECT *, CASE WHEN x1 <= 1.05 AND y1 <= 1.05 AND coalesce(w, 0) <= 1.05 THEN 1.0 ELSE coalesce(w, 595.28) END AS pw, CASE WHEN x1 <= 1.05 AND y1 <= 1.05 AND coalesce(w, 0) <= 1.05 THEN 1.0 ELSE coalesce(h, 841.89) END AS ph FROM c),
 e AS (SELECT *, greatest(0.0, least(99.0, x0 / pw * 100)) AS l, greatest(0.0, least(99.0, y0 / ph * 100)) AS t FROM d)
 SELECT l_orderkey, l_linenumber, round(l, 4) AS left, round(t, 4) AS top, round(greatest(1.0, least(100 - l, abs((x1 - x0) / pw * 100))), 4) AS width, round(greatest(0.8, least(100 - t, abs((y1 - y0) / ph * 100))), 4) AS height,
 CASE WHEN l_orderkey % 7 = 0 THEN concat('D', l_orderkey, '-P', l_linenumber, '-no-bbox') ELSE concat('D', l_orderkey, '-P', l_linenumber, '-', printf('%.2f', x0), '_', printf('%.2f', y0)) END AS evidence_key FROM e""",
)
def evidence_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in shares of a page or in points, as percent of the page, and the keys of their places."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    small, stated = k % 4 == 0, k % 4 == 1
    x0, y0 = F.when(small, F.col("l_quantity") / 100.0).otherwise(F.col("l_quantity") * 10.0), F.when(small, n / 10.0).otherwise(n * 90.0)
    rows = table(spark, sf_dir, "lineitem").select(k, n, x0.alias("x0"), y0.alias("y0"), F.when(small, x0 + 0.2).otherwise(x0 + 30).alias("x1"), F.when(small, y0 + 0.001).otherwise(y0 + 2).alias("y1"), F.when(stated, 612.0).alias("w"), F.when(stated, 792.0).alias("h"))
    c = F.col
    box = D.box_percent(c("x0"), c("y0"), c("x1"), c("y1"), c("w"), c("h"))
    key = D.evidence_key(F.concat(F.lit("D"), k.cast("string")), n, F.when(k % 7 != 0, c("x0")), c("y0"))
    return rows.select("l_orderkey", "l_linenumber", box.alias("b"), key.alias("evidence_key")).select("l_orderkey", "l_linenumber", *[F.round(f"b.{x}", 4).alias(x) for x in ("left", "top", "width", "height")], "evidence_key")


@query("evidence_refs", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'policy' ELSE 'document' END AS document_type, CAST(greatest(1, doc_id % 4) AS INTEGER) AS page_number, trim(substr(text, 1, 120)) AS quoted_span FROM documents")
def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evidence, every third of them a policy."""
    ref = D.evidence_ref(F.col("doc_id"), F.lit("document"), (F.col("doc_id") % 4).cast("int"), F.col("text"), F.col("doc_id") % 3 == 0)
    return table(spark, sf_dir, "documents", "doc_id", "text").select(ref.alias("r")).select(F.col("r.document_id").alias("doc_id"), "r.document_type", "r.page_number", "r.quoted_span")


@query("matching_evidence", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = user_id AND lower(trim(o_orderpriority)) = CASE event_id % 3 WHEN 0 THEN '1-urgent' WHEN 1 THEN '5-low' ELSE 'none' END)")
def matching_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence of a type that the user's orders have or don't."""
    kinds = F.element_at(F.array(*map(F.lit, ["1-URGENT", " 5-low ", "none"])), (F.col("event_id") % 3 + 1).cast("int"))
    evidence = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("owner"), kinds.alias("kind"))
    return D.matching_evidence(evidence, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("kind")), "owner", "kind").select("event_id")


@query("finished_jobs", "SELECT event_id AS job_id FROM events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)")
def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserved job ids of which two thirds of those that orders have are still in work."""
    state = F.element_at(F.array(*map(F.lit, ["COMPLETED", "QUEUED", "PROCESSING"])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), state.alias("status"))
    return D.finished(table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id")), jobs, "job_id", "status")


@query(
    "settled_jobs",
    """SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'FAILED' ELSE 'PROCESSING' END AS status, CASE o_orderkey % 5 WHEN 3 THEN TIMESTAMP '1998-01-01 00:00:30' WHEN 4 THEN o_orderdate END AS locked_until,
 CAST(o_orderkey % 2 + CASE WHEN o_orderkey % 5 IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS retry_count FROM orders""",
)
def settled_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in work after they were acknowledged, put back, given up, extended or left alone."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job_id"), F.lit("PROCESSING").alias("status"), F.col("o_orderdate").alias("locked_until"), (k % 2).cast("int").alias("retry_count"))
    outcomes = table(spark, sf_dir, "orders").filter(k % 5 < 4).select(k.alias("job_id"), F.element_at(F.array(*map(F.lit, ["ack", "retry", "fail", "extend"])), (k % 5 + 1).cast("int")).alias("outcome"), F.lit(30).alias("seconds"))
    return W.settled(jobs, "job_id", "status", "locked_until", "retry_count", outcomes, F.to_timestamp(F.lit("1998-01-01 00:00:00")))


@query("cited_passages", "SELECT conv_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS ids FROM (SELECT DISTINCT conv_id, [concat('c', conv_id % 4), concat('c', conv_id % 7 + 10)] AS a, ['c1', 'c12', 'c3'] AS b FROM conversations)")
def cited_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved ids and after them those that are always cited."""
    c = F.col("conv_id")
    got = F.array(F.concat(F.lit("c"), (c % 4).cast("string")), F.concat(F.lit("c"), (c % 7 + 10).cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.array_join(D.append_unique(got, F.array(*map(F.lit, ["c1", "c12", "c3"]))), ",").alias("ids"))


@query(
    "kept_answers",
    """WITH q AS (SELECT event_id, user_id, event_type AS question, CAST(value > 50 AS INTEGER) AS state, ts FROM events), k AS (SELECT event_id AS answer, user_id, event_type AS question, CAST(value > 50 AS INTEGER) AS state, ts FROM events WHERE event_id % 2 = 0)
 SELECT q.event_id, arg_max(answer, struct_pack(t := k.ts, a := answer)) AS answer FROM q LEFT JOIN k ON q.user_id = k.user_id AND q.question = k.question AND q.state = k.state AND epoch(q.ts) - epoch(k.ts) BETWEEN 0 AND 86400 GROUP BY 1""",
)
def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second event is an answer that serves the same user's same question in the same state for a day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("question"), (F.col("value") > 50).cast("int").alias("state"), "ts")
    return D.kept_answers(e, e.filter("event_id % 2 = 0").withColumn("answer", F.col("event_id")), "user_id", "question", "state", "ts", 86_400).select("event_id", "answer")
