"""Answers to questions on an application, from passages of two scopes: its own dossier and the policies everybody may see.

Every question gets a row: an answer that lists findings and numbered passages with their ids, an abstention where there is
nothing to answer from, or a refusal of the question itself. An application's passages are never seen by another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval

# The longest question, characters of an excerpt, passages a scope, and the texts of an answer.
LONGEST, EXCERPT, PER_SCOPE = 1000, 400, 3
FINDINGS = "Deterministic Application Findings (already verified - cite as [RULE_ID]):"
ABSTAINED = "No relevant policy passages, dossier evidence, or application findings available for this question. I abstain rather than guess."
EMPTY, TOO_LONG = "Question cannot be empty", "Question exceeds 1000 characters"
POLICY = "POLICY"


def plain(question: Column | str) -> Column:
    """A question with runs of white space as one blank, and none around it."""
    return F.trim(F.regexp_replace(F.coalesce(question if isinstance(question, Column) else F.col(question), F.lit("")), r"\s+", " "))


def problem(question: Column | str) -> Column:
    """Why a question is refused; null if it isn't."""
    q = F.coalesce(question if isinstance(question, Column) else F.col(question), F.lit(""))
    bare = F.regexp_replace(q, r"^\s+|\s+$", "")
    return F.when(bare == "", EMPTY).when(F.length(bare) > LONGEST, TOO_LONG)


def scoped_passages(questions: DataFrame, policies: DataFrame, dossiers: DataFrame, k: int = PER_SCOPE, **how) -> DataFrame:
    """(question_id, n, chunk_id, is_policy, document_id, page_number, score, excerpt, text): the best k of each scope, the dossier's first, numbered through.

    questions: question_id, app, question; policies: chunk_id, document_id, page_number, text; dossiers: the same and app.
    A scope is a part of the hybrid index of its own, so counts and weights of one don't reach the other.
    """
    own = F.concat(F.lit("app:"), F.col("app").cast("string"))
    columns = ["chunk_id", "document_id", "page_number", "text"]
    passages = dossiers.select(own.alias("part"), *columns).unionByName(policies.select(F.lit(POLICY).alias("part"), *columns))
    good = questions.filter(problem("question").isNull())
    asked = good.select("question_id", plain("question").alias("question"), F.explode(F.array(own, F.lit(POLICY))).alias("part")).withColumn("q", F.struct("question_id", "part"))
    found = retrieval.hybrid(passages, asked.select("q", "part", "question"), "part", "chunk_id", "text", "q", "question", k, **how)
    hits = found.select("q.question_id", "part", "chunk_id", "rank", "score").join(passages, ["part", "chunk_id"])
    policy = F.col("part") == POLICY
    text = F.trim("text")
    excerpt = F.concat(F.substring(text, 1, EXCERPT), F.when(F.length(text) > EXCERPT, "...").otherwise(""))
    row = F.struct(policy.alias("is_policy"), "rank", "chunk_id", "document_id", "page_number", "score", excerpt.alias("excerpt"), text.alias("text"))
    per = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("hits"))  # 2 k at most
    return per.select("question_id", F.posexplode("hits").alias("at", "h")).select("question_id", (F.col("at") + 1).alias("n"), "h.chunk_id", "h.is_policy", "h.document_id", "h.page_number", "h.score", "h.excerpt", "h.text")


def answers(questions: DataFrame, hits: DataFrame, findings: DataFrame) -> DataFrame:
    """(question_id, app, status, answer, cited): answered, abstained or refused, with the ids that the answer cites.

    hits as ``scoped_passages`` gives them; findings: app, seq, rule_id, rule_name, verdict, reason.
    """
    source = F.when(F.col("is_policy"), "Policy").otherwise(F.concat(F.lit("Document "), F.coalesce(F.col("document_id").cast("string"), F.lit("None"))))
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), "chunk_id", F.lit("] ("), source, F.lit(") "), "excerpt")
    listed = hits.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("n", line.alias("line"), "chunk_id"))).alias("hits"), F.count_if(~F.col("is_policy")).alias("own"), F.count_if("is_policy").alias("policy"))
    said = F.concat(F.lit("- ["), "rule_id", F.lit("] "), "rule_name", F.lit(" (verdict="), "verdict", F.lit("): "), "reason")
    context = findings.groupBy("app").agg(F.sort_array(F.collect_list(F.struct("seq", said.alias("line"), "rule_id"))).alias("findings"))
    rows = questions.join(listed, "question_id", "left").join(context, "app", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    head = F.concat(F.lit("Top passages relevant to: "), plain("question"), F.lit(" ("), count("own"), F.lit(" from dossier, "), count("policy"), F.lit(" from policy)"))
    lines = lambda c: F.array_join(F.transform(c, lambda x: x["line"]), "\n")
    text = F.concat_ws("\n", F.when(F.col("findings").isNotNull(), F.concat(F.lit(FINDINGS + "\n"), lines("findings"))), F.when(F.col("hits").isNotNull(), F.concat(head, F.lit("\n"), lines("hits"))))
    refused, nothing = problem("question"), F.col("hits").isNull() & F.col("findings").isNull()
    none = F.array().cast("array<string>")
    cited = F.concat(F.coalesce(F.transform("hits", lambda x: x["chunk_id"]), none), F.coalesce(F.transform("findings", lambda x: x["rule_id"]), none))
    return rows.select(
        "question_id", "app", F.when(refused.isNotNull(), "refused").when(nothing, "abstained").otherwise("answered").alias("status"),
        F.coalesce(refused, F.when(nothing, ABSTAINED), text).alias("answer"), F.when(refused.isNull(), cited).otherwise(none).alias("cited"),
    )


def cited_evidence(answered: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, and the columns of evidence): the evidence of the findings whose rule ids an answer of the same application cites."""
    cites = answered.select("question_id", "app", F.explode("cited").alias("rule_id"))
    return cites.join(evidence, ["app", "rule_id"]).select("question_id", *evidence.columns)
