"""Queries that answer questions: a conversation's first turn asks, its later turns are its dossier, the benchmark's items are the policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..sources.readers import table
from .catalog import query

STOP = ["the", "and", "of", "to", "in", "is", "it", "you", "that", "we"]
_WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+'))"


def hybrid_sql(k: int, deep: int) -> str:
    """CTEs up to ``best`` (q, part, key, lex_rank, dense_rank, score, rank) from p (part, key, text) and a (q, part, text), both without blank rows."""
    return f"""w AS (SELECT part, key, {_WORDS} AS term FROM p), tf AS (SELECT part, key, term, count(*) AS tf FROM w GROUP BY ALL), dl AS (SELECT part, key, sum(tf) AS length FROM tf GROUP BY ALL),
 st AS (SELECT part, count(*) AS n, sum(coalesce(length, 0)) / count(*) AS mean FROM p LEFT JOIN dl USING (part, key) GROUP BY 1), df AS (SELECT part, term, count(*) AS df, sum(tf) AS uses FROM tf GROUP BY ALL),
 raw AS (SELECT part, term, mean, (n - df + 0.5) / (df + 0.5) AS odds, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM df JOIN st USING (part)), fl AS (SELECT part, 0.25 * avg(raw) AS f FROM raw GROUP BY 1),
 idf AS (SELECT part, term, mean, CASE WHEN x > 0 THEN x ELSE ln(1 + odds) END AS idf FROM (SELECT *, CASE WHEN raw >= 0 THEN raw ELSE f END AS x FROM raw JOIN fl USING (part))),
 qt AS (SELECT q, part, term, count(*) AS qtf FROM (SELECT q, part, {_WORDS} AS term FROM a) GROUP BY ALL),
 lex AS (SELECT q, part, key, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))), 6) AS s FROM tf JOIN dl USING (part, key) JOIN qt USING (part, term) JOIN idf USING (part, term) GROUP BY ALL),
 voc AS (SELECT part, term, i FROM (SELECT part, term, ln((1 + n) / (1 + df)) + 1 AS i, row_number() OVER (PARTITION BY part ORDER BY uses DESC, term) AS r FROM df JOIN st USING (part) WHERE length(term) > 1 AND term NOT IN ({', '.join(f"'{x}'" for x in STOP)})) WHERE r <= 256),
 x AS (SELECT part, key, term, tf * i AS x FROM tf JOIN voc USING (part, term)), y AS (SELECT q, part, term, qtf * i AS y FROM qt JOIN voc USING (part, term)), nx AS (SELECT part, key, sqrt(sum(x * x)) AS nx FROM x GROUP BY ALL), ny AS (SELECT q, part, sqrt(sum(y * y)) AS ny FROM y GROUP BY ALL),
 den AS (SELECT q, part, key, round(sum(x * y) / (any_value(nx) * any_value(ny)), 6) AS s FROM x JOIN y USING (part, term) JOIN nx USING (part, key) JOIN ny USING (q, part) GROUP BY ALL),
 r AS (SELECT a.q, a.part, p.key, row_number() OVER (PARTITION BY a.q, a.part ORDER BY coalesce(lex.s, 0) DESC, p.key) AS l, row_number() OVER (PARTITION BY a.q, a.part ORDER BY coalesce(den.s, 0) DESC, p.key) AS d
   FROM a JOIN p USING (part) LEFT JOIN lex ON lex.q = a.q AND lex.part = a.part AND lex.key = p.key LEFT JOIN den ON den.q = a.q AND den.part = a.part AND den.key = p.key),
 f AS (SELECT q, part, key, CASE WHEN l <= {deep} THEN l END AS lex_rank, CASE WHEN d <= {deep} THEN d END AS dense_rank FROM r WHERE l <= {deep} OR d <= {deep}),
 g AS (SELECT *, round(coalesce(1.0 / (60 + lex_rank), 0.0) + coalesce(1.0 / (60 + dense_rank), 0.0), 6) AS score FROM f),
 best AS (SELECT q, part, key, lex_rank, dense_rank, score, row_number() OVER (PARTITION BY q, part ORDER BY score DESC, lex_rank NULLS LAST, dense_rank NULLS LAST, key) AS rank FROM g QUALIFY rank <= {k})"""


_PROBLEM = f"CASE WHEN question = '' THEN '{A.EMPTY}' WHEN length(question) > {A.LONGEST} THEN '{A.TOO_LONG}' END"
_ASKED = f"""asked AS (SELECT *, {_PROBLEM} AS problem FROM (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN '' WHEN conv_id % 13 = 0 THEN repeat('why ', 300) ELSE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) END AS question FROM conversations WHERE turn = 0)),
 p AS (SELECT 'app:' || conv_id AS part, 'turn-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS key, coalesce(text, '') AS text, conv_id AS document_id FROM conversations WHERE turn > 0 AND conv_id % 17 <> 0 UNION ALL SELECT 'POLICY', 'policy-' || lpad(CAST(item_id AS VARCHAR), 6, '0'), text, item_id FROM benchmark WHERE item_id % 2 = 0),
 a AS (SELECT conv_id AS q, unnest(['app:' || conv_id, 'POLICY']) AS part, question AS text FROM asked WHERE problem IS NULL)"""


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, policies, dossiers and findings. Some questions are empty or too long, some conversations have no passages of their own."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    key = F.col("conv_id")
    text = F.when(key % 11 == 0, " \n ").when(key % 13 == 0, F.repeat(F.lit("why "), 300)).otherwise(F.col("text"))
    questions = c.filter("turn = 0").select(key.alias("question_id"), key.alias("app"), text.alias("question"))
    dossiers = c.filter("turn > 0 and conv_id % 17 <> 0").select(key.alias("app"), F.concat(F.lit("turn-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id"), key.alias("document_id"), (F.col("turn") + 1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))
    item = F.col("item_id")
    policies = table(spark, sf_dir, "benchmark").filter(item % 2 == 0).select(F.concat(F.lit("policy-"), F.lpad(item.cast("string"), 6, "0")).alias("chunk_id"), item.alias("document_id"), F.lit(1).cast("long").alias("page_number"), "text")
    findings = questions.filter("app % 3 = 0").select("app", F.lit(1).alias("seq"), F.lit("RULE-INC-01").alias("rule_id"), F.lit("Income").alias("rule_name"), F.lit("flag").alias("verdict"), F.concat(F.lit("conversation "), F.col("app").cast("string")).alias("reason"))
    return questions, policies, dossiers, findings


@query(
    "scoped_answers",
    f"""WITH {_ASKED}, {hybrid_sql(3, 10)},
 h AS (SELECT best.*, trim(p.text) AS t, p.document_id, row_number() OVER (PARTITION BY q ORDER BY part = 'POLICY', rank) AS n FROM best JOIN p USING (part, key)),
 l AS (SELECT q, string_agg(n || '. [' || key || '] (' || CASE WHEN part = 'POLICY' THEN 'Policy' ELSE 'Document ' || document_id END || ') ' || left(t, {A.EXCERPT}) || CASE WHEN length(t) > {A.EXCERPT} THEN '...' ELSE '' END, chr(10) ORDER BY n) AS lines,
   string_agg(key, ' ' ORDER BY n) AS keys, count(*) FILTER (part <> 'POLICY') AS own, count(*) FILTER (part = 'POLICY') AS policy FROM h GROUP BY q)
 SELECT conv_id AS question_id, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN lines IS NULL AND conv_id % 3 <> 0 THEN 'abstained' ELSE 'answered' END AS status,
   CASE WHEN problem IS NULL THEN concat_ws(' ', keys, CASE WHEN conv_id % 3 = 0 THEN 'RULE-INC-01' END) ELSE '' END AS cited,
   CASE WHEN problem IS NOT NULL THEN problem WHEN lines IS NULL AND conv_id % 3 <> 0 THEN '{A.ABSTAINED}' ELSE concat_ws(chr(10), CASE WHEN conv_id % 3 = 0 THEN '{A.FINDINGS}' || chr(10) || '- [RULE-INC-01] Income (verdict=flag): conversation ' || conv_id END,
     'Top passages relevant to: ' || question || ' (' || own || ' from dossier, ' || policy || ' from policy)' || chr(10) || lines) END AS answer FROM asked LEFT JOIN l ON conv_id = q""",
)
def scoped_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's opening answered from its own later turns and from the policies, with findings for some."""
    questions, policies, dossiers, findings = _inputs(spark, sf_dir)
    hits = A.scoped_passages(questions, policies, dossiers, stop=STOP)
    return A.answers(questions, hits, findings).select("question_id", "status", F.array_join("cited", " ").alias("cited"), "answer")
