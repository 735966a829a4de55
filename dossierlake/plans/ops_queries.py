"""Queries over queues, states, limits and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators import workqueue as W
from ..sources import readers
from ..sources.readers import table
from .catalog import query

_STATUS = "list_extract(['" + "', '".join(W.STATUS_ORDER) + "'], CAST(o_orderkey % 8 + 1 AS INTEGER))"
_NOW = "1998-01-01 00:00:00"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*map(F.lit, ["PENDING", "DISPATCHED", "PROCESSING", "PUBLISHED"]))
    k = F.col("o_orderkey")
    lease = F.when(k % 3 == 0, F.to_timestamp(F.lit("1997-06-01 00:00:00"))).when(k % 3 == 1, F.to_timestamp(F.lit("1999-01-01 00:00:00")))
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), F.element_at(states, (k % 4 + 1).cast("int")).alias("status"), lease.alias("locked_until"), F.col("o_orderdate").alias("created_at"))


_JOBS = """SELECT o_orderkey AS job_id, list_extract(['PENDING', 'DISPATCHED', 'PROCESSING', 'PUBLISHED'], CAST(o_orderkey % 4 + 1 AS INTEGER)) AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '1997-06-01 00:00:00' WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1999-01-01 00:00:00' END AS locked_until, o_orderdate AS created_at FROM orders"""
_CLAIMABLE = f"(status IN ('PENDING', 'DISPATCHED') AND (locked_until IS NULL OR locked_until < TIMESTAMP '{_NOW}') OR status = 'PROCESSING' AND locked_until < TIMESTAMP '{_NOW}')"


@query("work_list", f"SELECT o_orderkey, {_STATUS} AS status FROM orders ORDER BY o_orderkey % 8, o_orderdate DESC, o_orderkey LIMIT 20")
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty first applications of a reviewer's list."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.element_at(F.array(*map(F.lit, W.STATUS_ORDER)), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("status"))
    return W.work_list(rows, "status", "o_orderdate", "o_orderkey", 20).select("o_orderkey", "status")


@query("fifo_claim", f"WITH j AS ({_JOBS}), t AS (SELECT job_id FROM j WHERE {_CLAIMABLE} ORDER BY created_at, job_id LIMIT 10) SELECT job_id, CASE WHEN job_id IN (SELECT job_id FROM t) THEN 'PROCESSING' ELSE status END AS status, CASE WHEN job_id IN (SELECT job_id FROM t) THEN TIMESTAMP '1998-01-01 00:01:30' ELSE locked_until END AS locked_until FROM j")
def fifo_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after the ten oldest free jobs have been taken under a lease of ninety seconds."""
    now = F.to_timestamp(F.lit(_NOW))
    return W.claim(_jobs(spark, sf_dir), "status", "locked_until", "created_at", "job_id", now, 10).select("job_id", "status", "locked_until")


@query("lease_reclaim", f"WITH j AS ({_JOBS}) SELECT status, count(*) AS n FROM j WHERE {_CLAIMABLE} GROUP BY 1")
def lease_reclaim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.claimable(_jobs(spark, sf_dir), "status", "locked_until", F.to_timestamp(F.lit(_NOW))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("outbox_publish", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'PUBLISHED' WHEN event_id % 4 + 1 >= 3 THEN 'FAILED' ELSE 'PENDING' END AS status, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 4 ELSE event_id % 4 + 1 END AS INTEGER) AS retry_count FROM events""")
def outbox_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outbox after one attempt for each event, of which every second one fails."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("PENDING").alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"), (F.col("event_id") % 2 == 0).alias("ok"))
    return W.after_publish(rows, "ok", "status", "retry_count")


_ALLOWED = {"signup": ["view"], "view": ["view", "click"], "click": ["view", "click", "purchase"], "purchase": ["view"], "error": ["view", "click", "error"]}
_MOVES = "SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events"


@query("status_transitions", f"SELECT from_state, event_type AS to_state, count(*) AS n FROM ({_MOVES}) GROUP BY ALL")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = W.transitions(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"), "user_id", "ts", "event_id", "event_type")
    return moves.groupBy("from_state", F.col("event_type").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


@query("illegal_transitions", f"SELECT event_id, from_state, event_type AS to_state FROM ({_MOVES}) WHERE from_state IS NOT NULL AND NOT (" + " OR ".join(f"from_state = '{k}' AND event_type IN ({', '.join(repr(x) for x in v)})" for k, v in _ALLOWED.items()) + ")")
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = W.transitions(table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts"), "user_id", "ts", "event_id", "event_type")
    return W.illegal(moves, "event_type", _ALLOWED).select("event_id", "from_state", F.col("event_type").alias("to_state"))


_STEPS = "WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, {tie}) AS n FROM ({rows}))"


@query(
    "rate_limit_accepts",
    _STEPS.format(tie="event_id", rows="SELECT user_id, event_id, epoch(ts) AS t FROM events")
    + """, r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, false AS allowed, 0 AS remaining, 0 AS retry_after, CAST([] AS DOUBLE[]) AS live FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, n, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN CAST(1 - len(live) AS INTEGER) ELSE 0 END, CASE WHEN len(live) < 2 THEN 0 ELSE greatest(1, CAST(trunc(live[1] + 21600 - t) AS INTEGER) + 1) END, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END
 FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(r.live, lambda x: x > e.t - 21600) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
 SELECT user_id, event_id, allowed, remaining, retry_after FROM r WHERE n > 0""",
)
def rate_limit_accepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limit of two in six hours lets through; refused ones don't count."""
    return W.rate_limited(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", 6 * 3600.0, 2)


@query(
    "slot_guard",
    _STEPS.format(tie="job", rows="SELECT user_id, CASE WHEN event_type = 'signup' THEN event_id - 1 ELSE event_id END AS job, event_type = 'signup' AS freed, epoch(ts) AS t FROM events")
    + """, r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS job, true AS freed, false AS granted, CAST([] AS STRUCT(j BIGINT, t DOUBLE)[]) AS held FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, n, job, freed, NOT freed AND (own OR len(held) < 2), CASE WHEN freed THEN list_filter(held, lambda x: x.j <> job) WHEN own OR len(held) < 2 THEN list_append(list_filter(held, lambda x: x.j <> job), struct_pack(j := job, t := t)) ELSE held END
 FROM (SELECT *, len(list_filter(held, lambda x: x.j = job)) > 0 AS own FROM (SELECT e.user_id, e.n, e.job, e.freed, e.t, list_filter(r.held, lambda x: x.t > e.t - 86400) AS held FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
 SELECT user_id, job, granted FROM r WHERE n > 0 AND NOT freed""",
)
def slot_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases ask for one of two slots a user that lapse after a day; signups free the event before."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") == "signup", F.col("event_id") - 1).otherwise(F.col("event_id")).alias("job"), F.when(F.col("event_type") == "signup", "release").otherwise("reserve").alias("action"))
    return W.slots(e, "user_id", "ts", "job", "action", 2, 86400.0)


@query("history_merge", """WITH o AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS all_ FROM events GROUP BY 1) SELECT user_id, array_to_string(list_concat(all_[1:3], list_filter(all_[4:], lambda x: NOT list_contains(all_[1:3], x))), ',') AS history FROM o""")
def history_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first three events, and of all later ones those of kinds that aren't among them."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "ts").select("user_id", "event_type", n.alias("n"))
    merged = W.merge_rows(events.filter("n <= 3"), events.filter("n > 3"), "user_id", "event_type")
    return merged.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda x: x["event_type"]), ",").alias("history"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("latest_event", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest).select("user_id", "x.*")


@query("upsert_customers", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'MERGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey - 1, 'NEW' FROM customer WHERE c_custkey % 50 = 0")
def upsert_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after a merge that changes a fifth and adds some."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    changed = c.filter("c_custkey % 5 = 0").select("c_custkey", F.lit("MERGED").alias("c_mktsegment"))
    added = c.filter("c_custkey % 50 = 0").select((-F.col("c_custkey") - 1).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    return readers.upserted(c, changed.union(added), "c_custkey")


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by six-hour windows."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query(
    "session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: runs of a user's events with gaps of less than twelve hours."""
    return table(spark, sf_dir, "events").groupBy(F.session_window("ts", "12 hours").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: counts by every combination."""
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("export_json", """SELECT o_orderkey, concat('{"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '"}') AS json FROM orders""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("json"))


@query("sla_clock", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not_started' WHEN 900 - date_diff('second', o_orderdate, TIMESTAMP '1996-06-01 00:10:00') <= 0 THEN 'breached' ELSE 'running' END AS sla FROM orders""")
def sla_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen minutes from an order's date, as of a fixed time."""
    left = 900 - F.timestamp_diff("SECOND", F.col("o_orderdate").cast("timestamp"), F.to_timestamp(F.lit("1996-06-01 00:10:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "not_started").when(left <= 0, "breached").otherwise("running").alias("sla"))


@query("search_customers", "SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)), 'mach')")
def search_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which id, name or state holds a text."""
    return table(spark, sf_dir, "customer").filter(F.lower(F.concat_ws(" ", "c_custkey", "c_name", "c_mktsegment")).contains("mach")).select("c_custkey")


@query("confidence_bands", "SELECT CASE WHEN c >= 0.75 THEN 'high' WHEN c >= 0.50 THEN 'medium' WHEN c IS NULL THEN 'heuristic' ELSE 'low' END AS band, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 100 / 100.0 END AS c FROM events) GROUP BY 1")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 100 / 100.0)
    band = F.when(c >= 0.75, "high").when(c >= 0.50, "medium").when(c.isNull(), "heuristic").otherwise("low")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("status_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by state, a column each."""
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0).select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in "FOP"])


@query("dispatch_stats", "SELECT count(*) AS claimed, count(*) FILTER (event_id % 2 = 0) AS published, count(*) FILTER (event_id % 2 = 1 AND event_id % 4 + 1 < 3) AS retried, count(*) FILTER (event_id % 2 = 1 AND event_id % 4 + 1 >= 3) AS failed FROM events")
def dispatch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one round of publishing did."""
    done = outbox_publish(spark, sf_dir)
    return done.agg(F.count(F.lit(1)).alias("claimed"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PUBLISHED", "published"), ("PENDING", "retried"), ("FAILED", "failed"))])


@query("top_probabilities", "SELECT p_partkey, list_extract(k, 1) AS first, list_extract(k, 2) AS second, list_extract(k, 3) AS third FROM (SELECT p_partkey, list_transform(list_sort([{'p': -(p_partkey * 7 % 101), 'k': 'a'}, {'p': -(p_partkey * 11 % 101), 'k': 'b'}, {'p': -(p_partkey * 13 % 101), 'k': 'c'}, {'p': -(p_partkey * 17 % 101), 'k': 'd'}]), lambda x: x.k) AS k FROM part)")
def top_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three likeliest of four classes of each part."""
    k = F.col("p_partkey")
    classes = F.array(*[F.struct((-(k * m % 101)).alias("p"), F.lit(c).alias("k")) for m, c in ((7, "a"), (11, "b"), (13, "c"), (17, "d"))])
    best = F.slice(F.array_sort(classes), 1, 3)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.get(best, F.lit(i))["k"].alias(n) for i, n in enumerate(("first", "second", "third"))])


@query("offline_answers", r"""WITH q AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: length(w) > 3)) AS ws FROM benchmark), w AS (SELECT item_id, unnest(ws) AS w FROM q), d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents),
 h AS (SELECT x.w AS word, y.w AS held FROM (SELECT DISTINCT w FROM w) x JOIN (SELECT DISTINCT w FROM d) y ON contains(y.w, x.w))
 SELECT item_id, count(DISTINCT doc_id) AS passages, min(doc_id) AS first FROM w JOIN h ON w.w = word JOIN d ON d.w = held WHERE doc_id IS NOT NULL GROUP BY 1""")
def offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question, how many documents hold one of its words of more than three characters, also within a longer word, and the first of them."""
    asked = table(spark, sf_dir, "benchmark", "item_id", "text")
    docs = readers.spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return retrieval.holding(docs, asked, "doc_id", "text", "item_id", "text").select("item_id", "passages", "first")


@query("label_union", "SELECT DISTINCT lang AS label FROM documents UNION SELECT DISTINCT source FROM documents")
def label_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "lang", "source")
    return docs.select(F.col("lang").alias("label")).union(docs.select("source")).distinct()


@query("heartbeat_gaps", "SELECT user_id, count(*) AS gaps FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d > INTERVAL 1 DAY GROUP BY 1")
def heartbeat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user was silent for more than a day."""
    moves = W.transitions(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), "user_id", "ts", "event_id", "ts")
    return moves.filter(F.col("ts") - F.col("from_state") > F.expr("INTERVAL 1 DAY")).groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"))


@query("event_before_order", """SELECT o_orderkey, event_id FROM (SELECT o_orderkey, event_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY d DESC, event_id DESC) AS n FROM (SELECT o_orderkey, o_custkey % 100 AS u, CAST(o_orderkey % 30 AS INTEGER) AS day FROM orders) JOIN (SELECT event_id, user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS d FROM events) ON u = user_id AND d <= day) WHERE n = 1""")
def event_before_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, an as-of join: the last event of a user up to the day of an order. Both sides meet in one sorted window, without a join."""
    from pyspark.sql import Window

    day = F.date_diff(F.col("ts").cast("date"), F.to_date(F.lit("2024-01-01")))
    right = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), day.alias("day"), F.lit(0).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    left = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("u"), (F.col("o_orderkey") % 30).cast("int").alias("day"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("u").orderBy("day", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("last", F.last("event_id", ignorenulls=True).over(w)).filter("side = 1 and last is not null").select("o_orderkey", F.col("last").alias("event_id"))
