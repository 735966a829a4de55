"""Typed facts from pages of text by patterns, each with the page and the words it came from.

The patterns are data: a table of (document type, fact, kind, pattern). A document's first page that matches a pattern
gives the fact; no match gives null with confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import grounding as G

# The tail of patterns that end in an amount, and the confidence of a fact that a pattern found.
_MONEY = r"(?:INR|₹|Rs\.?)?\s*([\d,]+(?:\.\d+)?)"
CONFIDENCE = 0.95
# Fixed values: (document type, fact, kind, pattern).
PATTERNS = [
    ("payslip", "employee_name", "text", r"(?:Employee\s+Name|Emp\s+Name|Name)\s*[:\-!|]?\s*([A-Za-z .]+)"),
    ("payslip", "employer_name", "text", r"(?:Employer\s+Name|Employer|Company\s+Name|Company|Organization)\s*[:\-!|]?\s*([A-Za-z0-9 .,&]+)"),
    ("payslip", "gross_salary", "money", r"(?:Gross\s+Salary|Gross\s+Pay|Gross\s+Earnings|Total\s+Earnings)\s*[:\-!|]?\s*" + _MONEY),
    ("payslip", "net_salary", "money", r"(?:Net\s+Salary|Net\s+Pay|Net\s+Take\s+Home|Take\s+Home\s+Pay|Net\s+Amount)\s*[:\-]?\s*" + _MONEY),
    ("payslip", "deductions", "money", r"(?:Total\s+Deductions|Deductions\s+Total|Total\s+Deduction)\s*[:\-]?\s*" + _MONEY),
    ("payslip", "pay_period", "text", r"(?:Pay\s+Period|For\s+the\s+month\s+of|Month)\s*[:\-]?\s*([A-Za-z0-9 ,-]+)"),
    ("bank_statement", "account_holder", "text", r"(?:Account\s+Holder|Customer\s+Name|Account\s+Name|Name)\s*[:\-!|]?\s*([A-Za-z .]+)"),
    ("bank_statement", "account_number", "account", r"(?:Account\s+No|Account\s+Number|A/C\s+No|Acct\s+No)\.?\s*[:\-]?\s*([X\d\-]{6,20})"),
    ("bank_statement", "closing_balance", "money", r"(?:Closing\s+Balance|Available\s+Balance|Account\s+Balance|Net\s+Balance)\s*[:\-]?\s*" + _MONEY),
    ("tax_acknowledgement", "assessee_name", "text", r"(?:Name\s+of\s+Assessee|Assessee\s+Name|Name|Taxpayer\s+Name)\s*[:\-]\s*([A-Za-z .]+)"),
    ("tax_acknowledgement", "pan", "pan", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"),
    ("tax_acknowledgement", "assessment_year", "text", r"(?:Assessment\s+Year|AY|A\.Y\.)\s*[:\-]?\s*(20\d{2}[-\s/]\d{2,4})"),
    ("tax_acknowledgement", "gross_total_income", "money", r"(?:Gross\s+Total\s+Income|Total\s+Income|Gross\s+Income)\s*[:\-]?\s*" + _MONEY),
    ("tax_acknowledgement", "tax_paid", "money", r"(?:Total\s+Tax\s+Paid|Tax\s+Paid|Taxes\s+Paid)\s*[:\-]?\s*" + _MONEY),
    ("id_card", "full_name", "text", r"(?:Full\s+Name|Name|Applicant\s+Name)\s*[:\-!|]?\s*([A-Za-z .]+)"),
    ("id_card", "dob", "text", r"(?:DOB|Date\s+of\s+Birth|Birth\s+Date)\s*[:\-]?\s*(\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4})"),
    ("id_card", "pan", "pan", r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"),
    ("id_card", "aadhaar", "aadhaar", r"(?:Aadhaar|UID|Aadhar)\s*(?:No\.?)?\s*[:\-]?\s*([X\d\s-]{12,16})"),
]
# Lines of a bank statement.
BANK_NAME = r"(?:Bank\s+Name\s*[:\-!|]?\s*([A-Za-z .]+)|(HDFC\s+Bank|ICICI\s+Bank|State\s+Bank\s+of\s+India|SBI|Axis\s+Bank|Kotak\s+Mahindra\s+Bank|Punjab\s+National\s+Bank))"
SALARY = r"(?:SALARY|SAL\s+CR|PAYROLL|DIRECT\s+DEP|NEFT.*SALARY|SALARY\s+CREDIT)[^\n\r]*?" + _MONEY
BOUNCE = r"\b(?:BOUNCE|RETURN|INSUFFICIENT\s+FUNDS|ECS\s+RETURN|CHQ\s+RTN)\b"


def _shown(kind: str, raw: Column) -> Column:
    return {"account": T.mask_account, "aadhaar": T.mask_aadhaar, "pan": F.upper}.get(kind, lambda x: x)(raw)


def facts(pages: DataFrame, doc: str, kind: str, page: str, text: str) -> DataFrame:
    """(doc, fact, value, amount, page_number, quoted_span, confidence): a row for each fact of a document's type.

    All patterns of a page are evaluated in one pass; a window picks each fact's first page.
    """
    tried = [
        F.when(F.col(kind) == t, F.struct(F.lit(f).alias("fact"), F.lit(k).alias("kind"), F.trim(F.regexp_extract(text, "(?i)" + p, 1)).alias("raw"), _shown(k, F.trim(F.regexp_extract(text, "(?i)" + p, 1))).alias("value")))
        for t, f, k, p in PATTERNS
    ]
    rows = pages.select(doc, page, F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("x")).select(doc, page, "x.*").withColumn("raw", F.when(F.col("raw") != "", F.col("raw")))
    first = F.row_number().over(Window.partitionBy(doc, "fact").orderBy(F.col("raw").isNull(), page))
    hit = F.col("raw").isNotNull()
    return rows.withColumn("_n", first).filter("_n = 1").select(
        doc, "fact", F.when(hit, F.col("value")).alias("value"), F.when(F.col("kind") == "money", T.money("raw")).alias("amount"), F.when(hit, F.col(page)).alias("page_number"),
        F.when(hit, F.col("value")).otherwise("UNKNOWN").alias("quoted_span"), F.when(hit, CONFIDENCE).otherwise(0.0).alias("confidence"),
    )


def bank_activity(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, bank_name, labelled_name, salary_credits, mean_credit, bounced) from a statement's pages.

    The first mention of a bank counts: bank_name is its label's text or the known bank that it names, labelled_name the label's text only, empty if it has none.
    """
    labelled = F.trim(F.regexp_extract(text, "(?i)" + BANK_NAME, 1))
    name = F.trim(F.coalesce(F.nullif(F.regexp_extract(text, "(?i)" + BANK_NAME, 1), F.lit("")), F.nullif(F.regexp_extract(text, "(?i)" + BANK_NAME, 2), F.lit(""))))
    credits = F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + SALARY), F.lit(1)), T.money), lambda x: x > 0)
    bounced = F.size(F.filter(F.split(text, r"\r?\n"), lambda line: F.regexp_like(line, F.lit("(?i)" + BOUNCE))))
    found = pages.select(doc, name.alias("bank_name"), labelled.alias("labelled_name"), credits.alias("c"), bounced.alias("b")).groupBy(doc).agg(F.max("bank_name").alias("bank_name"), F.max("labelled_name").alias("labelled_name"), F.flatten(F.collect_list("c")).alias("salary_credits"), F.sum("b").cast("int").alias("bounced"))
    total = F.aggregate("salary_credits", F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    return found.select(doc, "bank_name", "labelled_name", "salary_credits", F.bround(total / F.when(F.size("salary_credits") > 0, F.size("salary_credits")), 2).cast("decimal(18,2)").alias("mean_credit"), "bounced")


def first_facts(pages: DataFrame, key: str, doc: str, order: str, page: str, text: str) -> DataFrame:
    """(key, kind, doc, fact, value, amount, page_number, quoted_span, confidence, defused): the facts of each key's documents, read as far as the rules need them.

    Texts are defused before anything reads them. A document's type is told by the words of its pages, taken together; of several
    documents of a type the first by ``order`` counts. Documents of other types give nothing.
    """
    clean = pages.select(key, doc, order, page, F.col(text).alias("_raw"), G.defused(text).alias("_text"))
    parts = clean.groupBy(key, doc, order).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(page, "_raw"))), lambda x: x["_raw"]), " ").alias("all"), F.bool_or(F.col("_raw") != F.col("_text")).alias("defused"))
    typed = parts.select(key, doc, order, "defused", T.type_by_words("all").alias("kind")).filter(F.col("kind") != "unknown")
    first = typed.groupBy(key, "kind").agg(F.min_by(F.struct(doc, "defused"), F.struct(order, doc)).alias("_d")).select(key, "kind", F.col(f"_d.{doc}").alias(doc), "_d.defused")
    found = facts(clean.join(first.drop(key), doc), doc, "kind", page, "_text")
    return found.join(first, doc).select(key, "kind", doc, *[c for c in found.columns if c != doc], "defused")


def span_box(words: DataFrame, doc: str, page: str, near: float = 15.0) -> DataFrame:
    """The union of the boxes of a phrase's words (doc, page, x0, y0, x1, y1), of those on the first one's line."""
    w = Window.partitionBy(doc, page)
    line = words.withColumn("_y", F.min("y0").over(w)).filter(F.col("y0") - F.col("_y") < near)
    return line.groupBy(doc, page).agg(*[F.round(f(c), 2).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
