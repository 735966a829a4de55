"""The queries opN_<name>, each a thin use of its operator, and the SQL that some have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf_langid, decontaminate, fill_middle, maxscore, near_dup, phrases, prefix_tree, quality_mil, sharding, toxicity, url_filter, warc
from .common import small_batches

#: The rules of op1: fixed by its contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: The threshold of op5: fixed by its contract.
QUALITY_THRESHOLD = 0.3
QUERY_EVERY, TOP_K = 100, 10
TOXIC_THRESHOLD = 0.2


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def _fold(column: str, folds: int):
    """crc32 of an id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def _rank_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _read(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge_urls(urls, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each category's probability, and whether the chain calls it toxic."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    chain = toxicity.train(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.probabilities(docs, chain)
    return scored.select("doc_id", (F.col("toxic") >= TOXIC_THRESHOLD).alias("flagged"), *[F.col(c).alias(f"p_{c}") for c in toxicity.CATEGORIES])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights from the labelled rows outside the held-out fold."""
    return quality_mil.train(docs, labels.filter(_fold("doc_id", 5) != 0).select("doc_id", "quality"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    weights = quality_model(docs, _read(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_mil.score_only(docs, weights).select(
        "doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    )


def op6_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.balanced_shards(_read(spark, sf_dir, "documents", "doc_id", "text"), shards=16)


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    queries = vectors.filter(F.col("id") % QUERY_EVERY == 0)
    return maxscore.top_k(vectors, queries, TOP_K).withColumnRenamed("id", "vec_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents", "doc_id", "text"), *_rank_file())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"), percent=85)


def language_model(docs: DataFrame) -> dict | None:
    """Weights from the rows outside the held-out fold."""
    return crf_langid.train(docs.filter(_fold("doc_id", 4) != 2))


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return crf_langid.languages(docs.select("doc_id", "text"), language_model(docs)).select("doc_id", F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents", "text", "lang"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents", "doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fill_middle.restored()).alias("restored_sha256"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.jaccard_components(_read(spark, sf_dir, "documents", "doc_id", "text"), percent=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_warc, op3_toxicity_chain, op4_benchmark_decontamination, op5_quality_classifier, op6_balanced_sharding, op7_maxscore, op8_byte_bpe, op9_minhash_near_dedup, op10_crf_language_id, op11_collocations, op12_fill_in_middle, op13_jaccard_join)
}

ORACLES: dict[str, str] = {
    "op1_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(rule, verdict, rule_host, rule_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), hits AS (
  SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS n
  FROM urls LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to FROM m""",
    "op4_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, string_split_regex(t, '[ \t-\r]+') AS w FROM (SELECT doc_id, trim(lower(text), E' \t\n\x0b\x0c\r') AS t FROM documents) WHERE t <> ''
), i AS (
  SELECT DISTINCT item_id, w, len(w) AS n, least(len(w), 5) AS width FROM (SELECT item_id, string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '[ \t-\r]+') AS w FROM benchmark) WHERE w[1] <> ''
), g AS (
  SELECT item_id, n, width, n - width + 1 AS m, array_to_string(w[p + 1:p + width], ' ') AS gram, count(*) AS c FROM (SELECT *, unnest(range(n - width + 1)) AS p FROM i) GROUP BY ALL
), s AS (
  SELECT doc_id, total, width, p, array_to_string(w[p + 1:p + width], ' ') AS gram FROM (SELECT doc_id, w, len(w) AS total, width, unnest(range(len(w) - width + 1)) AS p FROM d, (SELECT DISTINCT width FROM i) WHERE len(w) >= width)
), hit AS (
  SELECT doc_id, item_id, width, m, least(n, total) AS length, total, p, gram, c FROM s JOIN g USING (width, gram)
), enough AS (
  SELECT doc_id, item_id FROM hit GROUP BY doc_id, item_id, m HAVING 100 * count(*) >= 80 * m
), starts AS (
  SELECT DISTINCT doc_id, item_id, unnest(range(greatest(0, p - length + width), least(p, total - length) + 1)) AS start FROM hit JOIN enough USING (doc_id, item_id)
), win AS (
  SELECT doc_id, item_id, start, length, width, m, gram, least(count(*), c) AS k FROM starts JOIN hit USING (doc_id, item_id) WHERE p BETWEEN start AND start + length - width GROUP BY doc_id, item_id, start, length, width, m, gram, c
), sim AS (
  SELECT doc_id, item_id, start, length, sum(k) AS shared, length - width + 1 + m - sum(k) AS rest FROM win GROUP BY doc_id, item_id, start, length, width, m HAVING 100 * sum(k) >= 80 * (length - width + 1 + m - sum(k))
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / rest DESC, start, length DESC) AS r FROM sim)
SELECT doc_id, item_id, CAST(shared AS DOUBLE) / CAST(rest AS DOUBLE) AS similarity, CAST(start AS INTEGER) AS start_word, CAST(length AS INTEGER) AS n_words FROM best WHERE r = 1""",
    "op7_maxscore": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS node, b AS r FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON reach.r = sym.a),
c AS (SELECT node, min(r) AS low FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM s LEFT JOIN c ON doc_id = node""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang), g AS (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k) GROUP BY ALL
), c AS (SELECT * FROM g WHERE k >= 2 AND f >= 10), cut AS (
  SELECT c.lang, c.g, c.k, c.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score, i
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN g x ON x.lang = c.lang AND x.g = c.g[1:i] JOIN g y ON y.lang = c.lang AND y.g = c.g[i + 1:]
), low AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, i) AS o FROM cut), best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM low
  WHERE o = 1 AND NOT EXISTS (SELECT 1 FROM c t WHERE t.lang = low.lang AND t.k = low.k + 1 AND (t.g[1:low.k] = low.g OR t.g[2:] = low.g) AND 100 * t.f >= 50 * low.a)
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         list_transform(range(4), lambda i: CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM documents
), c AS (
  SELECT *, len(w) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b FROM d
), p AS (SELECT *, array_to_string(w[1:a], '') AS x, array_to_string(w[a + 1:b], '') AS y, array_to_string(w[b + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(y) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op13_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS node, b AS r FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON reach.r = sym.a),
c AS (SELECT node, min(r) AS low FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM s LEFT JOIN c ON doc_id = node""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
