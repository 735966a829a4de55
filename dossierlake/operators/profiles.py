"""From manifests to findings: nested facts unpivoted to typed rows, and rules that a profile's table of parameters drives.

A profile says which credit a salary is compared with, how far a tax return may be off, how the credits of the balance are
made, which documents are needed, and whether identity documents are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R

# The documents that a dossier needs, and the profiles' parameters.
NEEDED = ["application_form", "bank_statement", "id_card", "payslip", "tax_acknowledgement"]
PROFILES = {
    "manifest": {"credit": "mean", "income": 0.05, "tax": 0.05, "balance": "0.05", "credits": "total", "needed": {k: 3 if k == "payslip" else 1 for k in NEEDED}, "across_ids": False},
    "pipeline": {"credit": "first", "income": 0.05, "tax": 0.10, "balance": "0.05", "credits": "total_or_list", "needed": dict.fromkeys(NEEDED, 1), "across_ids": True},
}
ORDER = ["RULE-COMP-01", "RULE-INC-01", "RULE-TAX-01", "RULE-ID-01", "RULE-ID-02", "RULE-BANK-01"]
#: (kind, fact, the manifest's field that holds it, and the field that does where that one is null); lists of amounts are facts of several rows.
FACTS = [
    ("applicant", "full_name", "applicant_facts.full_name", "applicant_name"), ("applicant", "pan", "applicant_facts.pan_number", "kyc.pan_number"),
    ("payslip", "employee_name", "payslip.employee_name", None), ("payslip", "gross_salary", "financial_ground_truth.gross_monthly_salary", "payslip.gross_salary"), ("payslip", "net_salary", "financial_ground_truth.net_monthly_salary", "payslip.net_salary"),
    ("bank_statement", "account_holder", "bank_statement.account_holder", None), ("bank_statement", "salary_credit", "bank_statement.monthly_salary_credits", None), ("bank_statement", "average_balance", "bank_statement.average_balance", None),
    ("bank_statement", "opening_balance", "financial_ground_truth.bank_opening_balance", None), ("bank_statement", "closing_balance", "financial_ground_truth.bank_closing_balance", None),
    ("bank_statement", "total_credits", "financial_ground_truth.bank_total_credits", None), ("bank_statement", "total_debits", "financial_ground_truth.bank_total_debits", None),
    ("tax_acknowledgement", "assessee_name", "tax_return.assessee_name", None), ("tax_acknowledgement", "pan", "tax_return.pan_number", None), ("tax_acknowledgement", "gross_total_income", "financial_ground_truth.itr_gross_total_income", "tax_return.gross_total_income"),
]
TEXTS = {"full_name", "pan", "employee_name", "account_holder", "assessee_name"}
LISTS = {"salary_credit"}


def documents(manifests: DataFrame, key: str = "application_id") -> DataFrame:
    """(key, document, doc_type) of every document that a manifest generated, or else expects."""
    names = F.coalesce(F.when(F.size("generated_document_names") > 0, F.col("generated_document_names")), F.col("expected_documents"), F.array().cast("array<string>"))
    kind = F.col("document")
    typed = F.when(kind.contains("payslip"), "payslip").when(kind.contains("bank"), "bank_statement").when(kind.contains("itr") | kind.contains("tax"), "tax_acknowledgement").when(kind.contains("kyc") | kind.contains("id_card"), "id_card").when(kind.contains("application"), "application_form").otherwise("unknown")
    return manifests.select(key, F.explode(names).alias("document")).withColumn("doc_type", typed)


def _each(amounts: Column, kind: str, fact: str) -> Column:
    """A fact row for each amount of a list."""
    row = lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(fact).alias("fact"), i.alias("seq"), F.lit(None).cast("string").alias("value"), x.cast("decimal(18,2)").alias("amount"))
    return F.transform(F.coalesce(amounts, F.array().cast("array<decimal(18,2)>")), row)


def facts(manifests: DataFrame, key: str = "application_id") -> DataFrame:
    """(key, kind, fact, seq, value, amount): a row for each fact that a manifest states; kinds without a document give none.

    Names of a payslip, a statement or a return that a manifest lacks are the applicant's.
    """
    rows = []
    for kind, fact, field, other in FACTS:
        one = F.col(field) if other is None else F.coalesce(field, other)
        text, money = F.lit(None).cast("string"), F.lit(None).cast("decimal(18,2)")
        if fact in LISTS:
            rows.append(_each(one, kind, fact))
            continue
        if fact in TEXTS:
            text = one if kind == "applicant" or fact == "pan" else F.coalesce(one, "applicant_facts.full_name", "applicant_name")
        else:
            money = one.cast("decimal(18,2)")
        rows.append(F.array(F.struct(F.lit(kind).alias("kind"), F.lit(fact).alias("fact"), F.lit(0).alias("seq"), text.alias("value"), money.alias("amount"))))
    stated = manifests.select(key, F.explode(F.concat(*rows)).alias("f")).select(key, "f.*").filter("value is not null or amount is not null or fact = 'salary_credit'")
    have = documents(manifests, key).select(key, F.col("doc_type").alias("kind")).distinct()
    return stated.filter("kind = 'applicant'").unionByName(stated.filter("kind <> 'applicant'").join(have, [key, "kind"], "left_semi"))


def judged(applications: DataFrame, documents_: DataFrame, facts_: DataFrame, identities: DataFrame, profile: str, key: str = "application_id") -> DataFrame:
    """(key, seq, rule_id, verdict): the profile's findings in order; an application without two identity documents has no finding across them.

    documents_: key, doc_type; facts_ as ``facts`` gives them; identities: key, seq, name of each identity document.
    """
    p = PROFILES[profile]
    fact = lambda kind, name, column: F.max(F.when((F.col("kind") == kind) & (F.col("fact") == name), F.col(column)))
    credit = (F.col("kind") == "bank_statement") & (F.col("fact") == "salary_credit")
    wide = applications.select(key).join(facts_, key, "left").groupBy(key).agg(
        *[fact(kind, name, "value" if name in TEXTS else "amount").alias(f"{kind}_{name}") for kind, name, *_ in FACTS if name not in LISTS],
        F.transform(F.sort_array(F.collect_list(F.when(credit, F.struct("seq", "amount")))), lambda x: x["amount"]).alias("credits"),
    )
    comp = applications.select(key).join(R.completeness(documents_, p["needed"], key, "doc_type").select(key, F.col("verdict").alias("comp")), key, "left")
    names = facts_.filter(F.col("fact").isin("employee_name", "account_holder", "assessee_name")).select(key, F.col("kind"), F.col("value").alias("other"))
    pans = facts_.filter("kind = 'tax_acknowledgement' and fact = 'pan'").select(key, F.lit("tax_acknowledgement").alias("kind"), F.col("value").alias("other_pan"))
    compared = names.join(pans, [key, "kind"], "full_outer").join(wide.select(key, F.col("applicant_full_name").alias("applicant"), F.col("applicant_pan")), key)
    ident = R.identity(compared.select(key, F.coalesce("applicant", F.lit("")).alias("applicant"), "applicant_pan", F.coalesce("other", F.lit("")).alias("other"), "other_pan"), key).select(key, F.col("verdict").alias("ident"))
    across = R.identity_documents(identities, key, "seq", "name").select(key, F.when(F.col("verdict") == "pass", R.PASS).otherwise(R.FLAG).alias("across"))
    rows = wide.join(comp, key).join(ident, key, "left").join(across, key, "left")
    net, gross, credits = F.col("payslip_net_salary"), F.col("payslip_gross_salary"), F.col("credits")
    first = F.when(F.size(credits) > 0, F.get(credits, F.lit(0))).otherwise(F.coalesce("bank_statement_average_balance", "bank_statement_closing_balance"))
    income: Column = R.income(net, credits, p["income"]) if p["credit"] == "mean" else R.within(net, first, p["income"])
    listed = F.when(F.size(credits) > 0, F.aggregate(credits, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)")).cast("decimal(18,2)"))
    total = F.col("bank_statement_total_credits") if p["credits"] == "total" else F.coalesce("bank_statement_total_credits", listed)
    none = F.lit(None).cast("decimal(18,2)")
    verdicts = {
        "RULE-COMP-01": F.coalesce("comp", F.lit(R.UNKNOWN)), "RULE-INC-01": income, "RULE-TAX-01": R.tax(F.col("tax_acknowledgement_gross_total_income"), none, gross, p["tax"]), "RULE-ID-01": F.coalesce("ident", F.lit(R.UNKNOWN)),
        "RULE-ID-02": F.col("across") if p["across_ids"] else F.lit(None).cast("string"), "RULE-BANK-01": R.bank_balance(F.col("bank_statement_opening_balance"), F.col("bank_statement_closing_balance"), total, F.col("bank_statement_total_debits"), p["balance"]),
    }
    found = F.filter(F.array(*[F.struct(F.lit(r).alias("rule_id"), v.alias("verdict")) for r, v in verdicts.items()]), lambda x: x["verdict"].isNotNull())
    return rows.select(key, F.posexplode(found).alias("at", "f")).select(key, (F.col("at") + 1).alias("seq"), "f.rule_id", "f.verdict")
