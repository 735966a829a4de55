"""Queries that rank passages and judge rankings and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, metrics, retrieval
from ..sources.readers import spread, table
from ..sources.shared import kept
from . import extraction_queries
from .answer_queries import hybrid_sql
from .catalog import query
from .memo_queries import documents

K = 5
_WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))"
_POSTINGS = f"""w AS (SELECT doc_id, {_WORDS} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS length FROM w GROUP BY 1),
 q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_WORDS} AS term FROM benchmark) GROUP BY ALL), st AS (SELECT count(*) AS n, (SELECT sum(length) FROM dl) / count(*) AS mean FROM documents),
 df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT term, (n - df + 0.5) / (df + 0.5) AS odds, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df, st),
 idf AS (SELECT term, CASE WHEN x > 0 THEN x ELSE ln(1 + odds) END AS idf FROM (SELECT term, odds, CASE WHEN raw >= 0 THEN raw ELSE 0.25 * (SELECT avg(raw) FROM raw) END AS x FROM raw))"""
_BM25 = f"""{_POSTINGS}, s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS score FROM tf JOIN dl USING (doc_id) JOIN q USING (term) JOIN idf USING (term), st GROUP BY ALL),
 lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)"""


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return docs, table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    docs, asked = _corpus(spark, sf_dir)
    return retrieval.bm25(docs, asked, "doc_id", "text", "item_id", "question", k)


@query("bm25_topk", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lex WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item's words."""
    return _bm25(spark, sf_dir, K).select("item_id", "doc_id", "score", "rank")


@query("tf_overlap_topk", f"WITH {_POSTINGS}, s AS (SELECT item_id, doc_id, CAST(sum(qtf) AS BIGINT) AS score FROM tf JOIN q USING (term) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= {K}")
def tf_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _corpus(spark, sf_dir)
    return retrieval.overlap(docs, asked, "doc_id", "text", "item_id", "question", K).select("item_id", "doc_id", "score", "rank")


_DENSE = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
 n AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS l FROM v),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.e, c.e) / (q.l * c.l), 6) AS score FROM n q JOIN n c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)"""


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= {K}")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar vectors with the same label (the tenant) for every fiftieth vector."""
    v = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    return retrieval.dense(v, asked, "vec_id", "embedding", "query_id", "q", K, "label").select("query_id", "vec_id", "score", "rank")


_STOP = ["the", "and", "of", "to", "in", "is", "it", "you", "that", "we"]


def _fused(spark: SparkSession, sf_dir: str, stop: list[str] | None = None) -> DataFrame:
    """All documents as one part of the hybrid index; without ``stop``, English stop words are left out of the vectors."""
    docs, asked = _corpus(spark, sf_dir)
    part = lambda df: df.withColumn("part", F.lit("all"))
    return retrieval.hybrid(part(docs), part(asked), "part", "doc_id", "text", "item_id", "question", K, stop=stop)


@query(
    "rrf_fusion",
    f"""WITH p AS (SELECT 'all' AS part, doc_id AS key, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), a AS (SELECT item_id AS q, 'all' AS part, text FROM benchmark WHERE trim(coalesce(text, '')) <> ''), {hybrid_sql(K, 15)}
 SELECT q AS item_id, key AS doc_id, CAST(lex_rank AS INTEGER) AS lex_rank, CAST(dense_rank AS INTEGER) AS dense_rank, score, CAST(rank AS INTEGER) AS rank FROM best""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings by BM25 and by TF-IDF vectors fused by reciprocal ranks."""
    return _fused(spark, sf_dir, _STOP).select("item_id", "doc_id", "lex_rank", "dense_rank", "score", "rank")


@query("retrieval_report")
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of the fusion, for items that some document holds word for word."""
    docs, asked = _corpus(spark, sf_dir)
    # A document that holds a question holds its words two to six in a row, which makes the search an equi-join.
    gram = lambda w, i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(5)])
    runs = docs.select("doc_id", F.split("text", r"\s+").alias("w")).select("doc_id", F.explode(F.transform("w", lambda _, i: gram("w", i))).alias("g"))
    keyed = asked.select("item_id", "question", gram(F.split("question", r"\s+"), F.lit(1)).alias("g"))
    met = runs.join(F.broadcast(keyed) if keyed.count() <= retrieval.FEW_TERMS else keyed, "g").select("doc_id", "item_id", "question").distinct()  # the text comes back for these only
    expected = kept(docs.join(met, "doc_id").filter(F.col("text").contains(F.col("question"))).select("item_id", "doc_id").distinct(), "expected")
    judged = retrieval.judged(_fused(spark, sf_dir), expected, "item_id", "doc_id", K).withColumn("split", F.when(F.col("item_id") % 3 == 0, "held_out").otherwise("dev"))
    return retrieval.retrieval_report(judged, "split")


@query(
    "hybrid_tenant",
    f"""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE turn > 0), a AS (SELECT conv_id AS q, conv_id, text FROM conversations WHERE turn = 0 AND trim(coalesce(text, '')) <> ''),
 w AS (SELECT conv_id, turn, {_WORDS} AS term FROM p), tf AS (SELECT conv_id, turn, term, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT conv_id, turn, sum(tf) AS length FROM tf GROUP BY ALL),
 st AS (SELECT conv_id, count(*) AS n, sum(coalesce(length, 0)) / count(*) AS mean FROM p LEFT JOIN dl USING (conv_id, turn) GROUP BY 1), df AS (SELECT conv_id, term, count(*) AS df, sum(tf) AS uses FROM tf GROUP BY ALL),
 raw AS (SELECT conv_id, term, mean, (n - df + 0.5) / (df + 0.5) AS odds, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df JOIN st USING (conv_id)), fl AS (SELECT conv_id, 0.25 * avg(raw) AS f FROM raw GROUP BY 1),
 idf AS (SELECT conv_id, term, mean, CASE WHEN x > 0 THEN x ELSE ln(1 + odds) END AS idf FROM (SELECT *, CASE WHEN raw >= 0 THEN raw ELSE f END AS x FROM raw JOIN fl USING (conv_id))),
 qt AS (SELECT q, conv_id, term, count(*) AS qtf FROM (SELECT q, conv_id, {_WORDS} AS term FROM a) GROUP BY ALL),
 lex AS (SELECT q, turn, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS s FROM tf JOIN dl USING (conv_id, turn) JOIN qt USING (conv_id, term) JOIN idf USING (conv_id, term) GROUP BY ALL),
 voc AS (SELECT conv_id, term, i FROM (SELECT conv_id, term, ln((1 + n) / (1 + df)) + 1 AS i, row_number() OVER (PARTITION BY conv_id ORDER BY uses DESC, term) AS r FROM df JOIN st USING (conv_id) WHERE length(term) > 1 AND term NOT IN ({', '.join(f"'{x}'" for x in _STOP)})) WHERE r <= 256),
 x AS (SELECT conv_id, turn, term, tf * i AS x FROM tf JOIN voc USING (conv_id, term)), y AS (SELECT q, conv_id, term, qtf * i AS y FROM qt JOIN voc USING (conv_id, term)), nx AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS nx FROM x GROUP BY ALL), ny AS (SELECT q, sqrt(sum(y * y)) AS ny FROM y GROUP BY 1),
 den AS (SELECT q, turn, round(sum(x * y) / (any_value(nx) * any_value(ny)), 6) AS s FROM x JOIN y USING (conv_id, term) JOIN nx USING (conv_id, turn) JOIN ny USING (q) GROUP BY ALL),
 r AS (SELECT a.q, a.conv_id, p.turn, row_number() OVER (PARTITION BY a.q ORDER BY coalesce(lex.s, 0) DESC, p.turn) AS l, row_number() OVER (PARTITION BY a.q ORDER BY coalesce(den.s, 0) DESC, p.turn) AS d FROM a JOIN p USING (conv_id) LEFT JOIN lex ON lex.q = a.q AND lex.turn = p.turn LEFT JOIN den ON den.q = a.q AND den.turn = p.turn),
 f AS (SELECT conv_id, turn, CASE WHEN l <= 15 THEN CAST(l AS INTEGER) END AS lex_rank, CASE WHEN d <= 15 THEN CAST(d AS INTEGER) END AS dense_rank FROM r WHERE l <= 15 OR d <= 15),
 g AS (SELECT *, round(coalesce(1.0 / (60 + lex_rank), 0.0) + coalesce(1.0 / (60 + dense_rank), 0.0), 6) AS score FROM f), h AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, lex_rank NULLS LAST, dense_rank NULLS LAST, turn) AS INTEGER) AS rank FROM g)
 SELECT conv_id, turn, lex_rank, dense_rank, score, rank FROM h WHERE rank <= {K}""",
)
def hybrid_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's opening asked of its own later turns: a conversation is a tenant, and nothing of another one is seen."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    asked = c.filter("turn = 0").select(F.col("conv_id").alias("q"), "conv_id", F.col("text").alias("question"))
    found = retrieval.hybrid(c.filter("turn > 0"), asked, "conv_id", "turn", "text", "q", "question", K, stop=_STOP)
    return found.select("conv_id", "turn", "lex_rank", "dense_rank", "score", "rank")


_PRED = """p AS (SELECT doc_id, lang AS truth, CASE WHEN t <> '' AND doc_id % 7 = 0 THEN 'en' ELSE lang END AS guess, (doc_id * 37 % 100) / 100.0 AS confidence FROM (SELECT doc_id, lang, text AS t FROM documents)), d AS (SELECT *, CASE WHEN confidence >= 0.40 THEN guess ELSE 'UNKNOWN' END AS decided FROM p)"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language with planted errors and confidences that follow from the id."""
    docs = table(spark, sf_dir, "documents")
    guess = F.when((F.col("text") != "") & (F.col("doc_id") % 7 == 0), "en").otherwise(F.col("lang"))
    return docs.select("doc_id", F.col("lang").alias("truth"), (F.col("text") != "").alias("some"), guess.alias("guess"), ((F.col("doc_id") * 37 % 100) / 100.0).alias("confidence"))


@query("confusion", f"WITH {_PRED} SELECT truth, decided, count(*) AS n FROM d GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(metrics.with_abstention(_predictions(spark, sf_dir), "guess", "confidence", 0.40), "truth", "decided")


_REPORT = f"""{_PRED}, l AS (SELECT truth AS label FROM d UNION SELECT decided FROM d), c AS (SELECT label, (SELECT count(*) FROM d WHERE truth = label) AS s, (SELECT count(*) FROM d WHERE decided = label) AS g, (SELECT count(*) FROM d WHERE truth = label AND decided = label) AS tp FROM l),
 r AS (SELECT label, CASE WHEN g > 0 THEN tp / CAST(g AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN s > 0 THEN tp / CAST(s AS DOUBLE) ELSE 0.0 END AS rc, s FROM c),
 f AS (SELECT label, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0.0 END, 6) AS f1, s AS support FROM r)"""


@query("class_report", f"WITH {_REPORT} SELECT * FROM f")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_report(metrics.with_abstention(_predictions(spark, sf_dir), "guess", "confidence", 0.40), "truth", "decided")


@query("report_summary", f"WITH {_REPORT} SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(class_report(spark, sf_dir))


_MACRO = lambda pred: f"(WITH {_REPORT.replace(_PRED, pred)} SELECT round(avg(f1), 6) FROM f)"


@query("model_choice", f"SELECT b AS baseline, c AS challenger, CASE WHEN c - b > 0.03 THEN 'CHALLENGER' ELSE 'BASELINE' END AS chosen FROM (SELECT {_MACRO(_PRED)} AS b, {_MACRO(_PRED.replace('doc_id % 7 = 0', 'doc_id % 3 = 0'))} AS c)")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro-F1 of two labelings of the documents, and which of them is chosen."""
    one = lambda df: metrics.summary(metrics.class_report(metrics.with_abstention(df, "guess", "confidence", 0.40), "truth", "decided"))
    first = _predictions(spark, sf_dir)
    second = first.withColumn("guess", F.when((F.col("doc_id") % 3 == 0) & F.col("some"), "en").otherwise(F.col("truth")))
    both = one(first).select(F.col("macro_f1").alias("baseline")).crossJoin(one(second).select(F.col("macro_f1").alias("challenger")))  # one row each
    return both.select("baseline", "challenger", metrics.chosen(F.col("baseline"), F.col("challenger")).alias("chosen"))


_THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.80]
_SWEEP = f"""{_PRED}, th(threshold) AS (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in _THRESHOLDS)}), e AS (SELECT threshold, truth AS t, CASE WHEN confidence >= threshold THEN guess ELSE 'UNKNOWN' END AS g FROM p, th),
 l AS (SELECT threshold, t AS label FROM e UNION SELECT threshold, g FROM e), a AS (SELECT threshold, t AS label, count(*) AS s, count(*) FILTER (t = g) AS tp FROM e GROUP BY ALL), b AS (SELECT threshold, g AS label, count(*) AS g FROM e GROUP BY ALL),
 f AS (SELECT threshold, 2.0 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(g, 0)) AS f1 FROM l LEFT JOIN a USING (threshold, label) LEFT JOIN b USING (threshold, label)), m AS (SELECT threshold, round(avg(f1), 6) AS macro_f1 FROM f GROUP BY 1)"""


@query("threshold_sweep", f"WITH {_SWEEP} SELECT threshold, macro_f1 FROM m")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_sweep(_predictions(spark, sf_dir), "truth", "guess", "confidence", _THRESHOLDS)


@query("best_threshold", f"WITH {_SWEEP} SELECT threshold, macro_f1 FROM m ORDER BY macro_f1 DESC, threshold LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(threshold_sweep(spark, sf_dir))


@query("escalation", f"WITH {_PRED} SELECT count(*) AS n, count(*) FILTER (guess = truth) AS would_be_right FROM d WHERE decided = 'UNKNOWN' AND confidence >= 0.15 AND confidence < 0.40")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = metrics.escalated(metrics.with_abstention(_predictions(spark, sf_dir), "guess", "confidence", 0.40), "decided", "confidence")
    return band.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("guess") == F.col("truth")).alias("would_be_right"))


@query(
    "doc_vote",
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 OR conv_id % 11 = 0 THEN 'UNKNOWN' ELSE role END AS label, (10 + length(text) % 80) / 100.0 AS confidence FROM conversations), s AS (SELECT conv_id, label, round(sum(confidence), 9) AS s, avg(confidence) AS m, min(turn) AS f FROM p WHERE label <> 'UNKNOWN' GROUP BY ALL),
 w AS (SELECT conv_id, label, round(m, 4) AS confidence, row_number() OVER (PARTITION BY conv_id ORDER BY s DESC, f) AS n FROM s) SELECT conv_id, coalesce(label, 'UNKNOWN') AS label, coalesce(confidence, 0.0) AS confidence, label IS NULL AS triage FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT * FROM w WHERE n = 1) USING (conv_id)""",
)
def doc_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation vote with their confidence, as pages of a document do; those of which none is known go to triage."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("turn") % 4 == 3) | (F.col("conv_id") % 11 == 0), "UNKNOWN").otherwise(F.col("role")).alias("label"), ((10 + F.length("text") % 80) / 100.0).alias("confidence"))
    return metrics.vote(pages, "conv_id", "turn", "label", "confidence")


@query("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), "event_type", "value")


@query("split_disjoint", "SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_custkey % 10 < 7 INTERSECT SELECT o_custkey FROM orders WHERE o_custkey % 10 >= 7)")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who are on both sides of a grouped split: none."""
    rows = classify.grouped_split(table(spark, sf_dir, "orders", "o_custkey"), "o_custkey", {"train": 70, "dev": 15, "test": 15})
    return rows.filter("split = 'train'").select("o_custkey").intersect(rows.filter("split <> 'train'").select("o_custkey")).agg(F.count(F.lit(1)).alias("shared"))


FIT_ROWS, FIT_SEED = 150, 42


@query("stratified_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7|' || doc_id), doc_id) <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source, drawn by seed."""
    return classify.sample(table(spark, sf_dir, "documents", "source", "doc_id"), "source", 5, 7, "doc_id")


@query("page_classifier")
def page_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of orders with their type, and conversations' turns, which have none, as negatives. The model is fitted on at most ``FIT_ROWS``
    pages of each type and judges all pages and turns; doc tells a page from a turn."""
    as_rows = lambda pages: pages.select("doc", F.col("kind").alias("label"), "text")
    docs = documents(spark, sf_dir).filter("doc_type is not null")
    # drawn before their texts are written, and once, as fitting reads them several times
    drawn = kept(as_rows(extraction_queries.pages_of(classify.sample(docs, "doc_type", FIT_ROWS, FIT_SEED, "document_id"))), "drawn")
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("doc"), F.lit(classify.UNKNOWN).alias("label"), "text")
    found = classify.predict(classify.fit(drawn), spread(as_rows(extraction_queries.pages_of(docs)).unionByName(turns)))  # judging is slow, so all cores take part
    return found.select("doc", "label", "label_pred", F.round("confidence", 3).alias("confidence"), "reason")
