"""Findings of both profiles over manifests that are made of the given customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles
from ..sources.readers import table
from .catalog import query
from .memo_queries import DOCS_SQL, documents

APPLICANT, SHORT, OTHER = "Anil Kumar Rao", "Kumar, Anil", "Zubin Qadir"
_NAME = lambda n: f"CASE {n} % 4 WHEN 0 THEN 'Mr. Rao Anil KUMAR' WHEN 1 THEN '{APPLICANT}' WHEN 2 THEN '{SHORT}' ELSE '{OTHER}' END"
_MONEY = "decimal(18,2)"


def _manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(manifests, identities): an application a customer, whose documents are the orders and whose facts follow from the first of each type."""
    docs = documents(spark, sf_dir)
    first = docs.filter("doc_type is not null").groupBy("app", "doc_type").agg(F.min_by("amount", "o_orderkey").alias("amount"), F.count(F.lit(1)).alias("n"))
    amount = lambda kind: F.max(F.when(F.col("doc_type") == kind, F.col("amount")))
    names = F.flatten(F.collect_list(F.when(F.col("doc_type") == "payslip", F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.lit("payslip_"), i, F.lit(".pdf")))).otherwise(F.array(F.create_map(*map(F.lit, ["bank_statement", "bank_statement.pdf", "tax_acknowledgement", "itr.pdf", "id_card", "kyc.pdf", "payslip", ""]))[F.col("doc_type")]))))
    c = table(spark, sf_dir, "customer", F.col("c_custkey").alias("app"), "c_acctbal").join(first, "app", "left").groupBy("app", "c_acctbal").agg(amount("payslip").alias("net"), amount("bank_statement").alias("bank"), amount("tax_acknowledgement").alias("tax"), F.array_sort(F.array_compact(names)).alias("names"))
    key, net = F.col("app"), F.col("net")
    money = lambda x: F.round(x, 2).cast(_MONEY)
    part = lambda share: money(net * F.lit(share).cast("decimal(4,2)"))
    credits = F.when(F.col("bank").isNotNull() & net.isNotNull(), F.when(key % 4 == 0, F.array(net)).when(key % 4 == 1, F.array(part("0.96"), part("0.80"))).when(key % 4 == 2, F.array(part("0.45"))).otherwise(F.array().cast(f"array<{_MONEY}>")))
    gross = part("1.25")
    stated = money(gross * 12 * F.when(key % 3 == 0, F.lit("0.93").cast("decimal(4,2)")).when(key % 3 == 1, F.lit("0.55").cast("decimal(4,2)")).otherwise(F.lit("1.00").cast("decimal(4,2)")))
    opening = money("c_acctbal")
    closing = money(opening + 900 - 400 + F.when(key % 5 == 0, F.lit("0.05").cast(_MONEY)).otherwise(F.lit("0.06").cast(_MONEY)))
    pan = lambda n: F.concat(F.lit("ABCDE"), F.lpad(((key + n) % 10000).cast("string"), 4, "0"), F.lit("F"))
    name = lambda n: F.when(n % 4 == 0, "Mr. Rao Anil KUMAR").when(n % 4 == 1, APPLICANT).when(n % 4 == 2, SHORT).otherwise(OTHER)
    none = F.lit(None)
    text, no = none.cast("string"), none.cast(_MONEY)
    full = F.when(key % 23 != 0, F.lit(APPLICANT))
    made = c.select(
        key.alias("application_id"), F.when(key % 2 == 0, F.concat("names", F.array(F.lit("application.pdf")))).otherwise(F.col("names")).alias("generated_document_names"), F.array(F.lit("application.pdf")).alias("expected_documents"), full.alias("applicant_name"),
        F.struct(full.alias("full_name"), pan(0).alias("pan_number")).alias("applicant_facts"), F.struct(text.alias("pan_number")).alias("kyc"),
        F.struct(
            F.when(key % 2 == 0, gross).alias("gross_monthly_salary"), net.alias("net_monthly_salary"), F.when(F.col("tax").isNotNull(), stated).alias("itr_gross_total_income"), opening.alias("bank_opening_balance"), closing.alias("bank_closing_balance"),
            F.when(key % 7 != 0, F.lit("900.00").cast(_MONEY)).alias("bank_total_credits"), F.lit("400.00").cast(_MONEY).alias("bank_total_debits"),
        ).alias("financial_ground_truth"),
        F.struct(F.when(key % 9 != 0, name(key)).alias("employee_name"), gross.alias("gross_salary"), no.alias("net_salary")).alias("payslip"),
        F.struct(F.lit(APPLICANT).alias("account_holder"), credits.alias("monthly_salary_credits"), F.when(key % 8 == 3, net).alias("average_balance")).alias("bank_statement"),
        F.struct(text.alias("assessee_name"), F.when(key % 6 == 0, "UNKNOWN").when(key % 6 == 1, pan(1)).when(key % 6 == 2, F.lower(pan(0))).alias("pan_number"), no.alias("gross_total_income")).alias("tax_return"),
    )
    ids = docs.filter("doc_type = 'id_card'").select(key.alias("application_id"), F.col("o_orderkey").alias("seq"), name(F.when(F.col("app") % 2 == 0, F.lit(1)).otherwise(F.col("o_orderkey"))).alias("name"))
    return made, ids


_WITHIN = "CASE WHEN {0} IS NULL OR {1} IS NULL OR {0} <= 0 OR {1} <= 0 THEN 'unknown' WHEN abs({0} - {1}) <= CAST({2} AS DECIMAL(6,4)) * {0} THEN 'pass' ELSE 'flag' END"
_PROFILE = """SELECT app, '{0}' AS profile, unnest([struct_pack(rule_id := 'RULE-COMP-01', verdict := CASE WHEN pay_n + bank_n + tax_n + id_n + form_n = 0 AND app % 2 = 1 THEN '{1}' WHEN pay_n >= {2} AND bank_n > 0 AND tax_n > 0 AND id_n > 0 AND form_n > 0 THEN 'pass' ELSE 'flag' END),
  struct_pack(rule_id := 'RULE-INC-01', verdict := {3}), struct_pack(rule_id := 'RULE-TAX-01', verdict := {4}), struct_pack(rule_id := 'RULE-ID-01', verdict := ident), struct_pack(rule_id := 'RULE-ID-02', verdict := {5}), struct_pack(rule_id := 'RULE-BANK-01', verdict := {6})]) AS f FROM v"""


def _sql() -> str:
    mean = "CASE WHEN net IS NULL OR len(credits) = 0 OR credits IS NULL THEN 'unknown' WHEN abs(net * len(credits) - list_sum(credits)) <= 0.05 * net * len(credits) THEN 'pass' ELSE 'flag' END"
    first = _WITHIN.format("net", "CASE WHEN len(credits) > 0 THEN credits[1] WHEN bank_n > 0 THEN coalesce(CASE WHEN app % 8 = 3 THEN net END, closing) END", "0.05")
    tax = lambda t: _WITHIN.format("gross12", "stated", t)
    total = "CASE WHEN app % 7 <> 0 THEN CAST(900 AS DECIMAL(18,2)) {} END"
    bank = lambda t: f"CASE WHEN bank_n = 0 OR opening IS NULL OR ({t}) IS NULL THEN 'unknown' WHEN abs(closing - (opening + ({t}) - 400)) <= 0.05 THEN 'pass' ELSE 'flag' END"
    count = lambda kind, name: f"count(*) FILTER (kind = '{kind}') AS {name}"
    least = lambda kind, name: f"arg_min(amount, o_orderkey) FILTER (kind = '{kind}') AS {name}"
    level = "CASE WHEN {0} % 4 = 3 THEN 2 WHEN {0} % 4 = 2 THEN 1 ELSE 0 END"
    manifest = _PROFILE.format("manifest", "unknown", 3, mean, tax("0.05"), "NULL", bank(total.format("")))
    pipeline = _PROFILE.format("pipeline", "unknown", 1, first, tax("0.10"), "across", bank(total.format("ELSE CAST(list_sum(credits) AS DECIMAL(18,2))")))
    return f"""WITH {DOCS_SQL}, d AS (SELECT app, {least('payslip', 'net')}, {least('bank_statement', 'bank')}, {least('tax_acknowledgement', 'tax')}, {count('payslip', 'pay_n')}, {count('bank_statement', 'bank_n')}, {count('tax_acknowledgement', 'tax_n')}, {count('id_card', 'id_n')} FROM docs GROUP BY app),
 i AS (SELECT app, CASE WHEN app % 2 = 0 THEN 1 ELSE o_orderkey END AS k, row_number() OVER (PARTITION BY app ORDER BY o_orderkey) AS r FROM docs WHERE kind = 'id_card'),
 x AS (SELECT a.app, CASE WHEN max(CASE WHEN {level.format('a.k')} = {level.format('b.k')} THEN 0 WHEN {level.format('a.k')} = 2 OR {level.format('b.k')} = 2 THEN 2 ELSE 1 END) = 0 THEN 'pass' ELSE 'flag' END AS across FROM i a JOIN i b ON a.app = b.app AND a.r = 1 AND b.r > 1 GROUP BY 1),
 c AS (SELECT c_custkey AS app, CAST(round(c_acctbal, 2) AS DECIMAL(18,2)) AS opening, net, bank, coalesce(pay_n, 0) AS pay_n, coalesce(bank_n, 0) AS bank_n, coalesce(tax_n, 0) AS tax_n, coalesce(id_n, 0) AS id_n, CASE WHEN c_custkey % 2 = 0 THEN 1 WHEN net IS NULL AND bank IS NULL AND tax IS NULL AND coalesce(id_n, 0) = 0 THEN 1 ELSE 0 END AS form_n,
   CAST(round(net * CAST(1.25 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS gross, across FROM customer LEFT JOIN d ON c_custkey = d.app LEFT JOIN x ON c_custkey = x.app),
 v AS (SELECT *, CAST(opening + 500 + CASE WHEN app % 5 = 0 THEN 0.05 ELSE 0.06 END AS DECIMAL(18,2)) AS closing, CASE WHEN pay_n > 0 THEN gross * 12 END AS gross12,
   CASE WHEN tax_n > 0 THEN CAST(round(gross * 12 * CAST(CASE app % 3 WHEN 0 THEN 0.93 WHEN 1 THEN 0.55 ELSE 1.00 END AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) END AS stated,
   CASE WHEN bank IS NULL OR net IS NULL THEN [] WHEN app % 4 = 0 THEN [net] WHEN app % 4 = 1 THEN [CAST(round(net * CAST(0.96 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)), CAST(round(net * CAST(0.80 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))] WHEN app % 4 = 2 THEN [CAST(round(net * CAST(0.45 AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))] ELSE [] END AS credits,
   CASE WHEN pay_n + bank_n + tax_n = 0 OR app % 23 = 0 THEN 'unknown' WHEN tax_n > 0 AND app % 6 = 0 THEN 'unknown' WHEN tax_n > 0 AND app % 6 = 1 THEN 'flag' WHEN pay_n > 0 AND app % 9 <> 0 AND app % 4 >= 2 THEN 'flag' ELSE 'pass' END AS ident FROM c),
 f AS ({manifest} UNION ALL {pipeline})
 SELECT app AS application_id, profile, f.rule_id AS rule_id, f.verdict AS verdict FROM f WHERE f.verdict IS NOT NULL"""


@query("profile_findings", _sql())
def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every application's findings by the profile for manifests and by the one for documents that were read."""
    made, ids = _manifests(spark, sf_dir)
    docs, stated, out = profiles.documents(made), profiles.facts(made), None
    for name in profiles.PROFILES:
        found = profiles.judged(made, docs, stated, ids, name).select("application_id", F.lit(name).alias("profile"), "rule_id", "verdict")
        out = found if out is None else out.unionByName(found)
    return out
