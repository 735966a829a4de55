"""Synthetic dossiers from a seed: eight scenarios with known outcomes, as expressions over a range of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scenarios with their number in a set of fifty, and the outcomes that are not pass.
SCENARIOS = {
    "clean": (10, {}),
    "missing_payslip": (5, {"RULE-COMP-01": "flag", "RULE-INC-01": "unknown", "RULE-TAX-01": "unknown"}),
    "salary_mismatch": (6, {"RULE-INC-01": "flag"}),
    "bank_mismatch": (6, {"RULE-INC-01": "flag"}),
    "tax_mismatch": (6, {"RULE-TAX-01": "flag"}),
    "missing_itr": (5, {"RULE-COMP-01": "flag", "RULE-TAX-01": "unknown"}),
    "identity_mismatch": (6, {"RULE-ID-01": "flag"}),
    "multiple_inconsistencies": (6, {"RULE-INC-01": "flag", "RULE-TAX-01": "flag", "RULE-ID-01": "flag"}),
}
FIRST, LAST = ["Asha", "Ravi", "Meera", "Kiran", "Leela", "Arjun", "Nisha", "Suresh"], ["Rao", "Mehta", "Iyer", "Kapoor", "Nair", "Das", "Gill"]
# The opening balance, the shares of a low credit and a low return, and the share that is spent.
OPENING, LOW_CREDIT, LOW_TAX, SPENT = "50000.00", "0.45", "0.55", "0.70"
RULES = ["RULE-COMP-01", "RULE-INC-01", "RULE-TAX-01", "RULE-ID-01", "RULE-BANK-01"]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def dossiers(spark: SparkSession, n: int = 50) -> DataFrame:
    """``n`` dossiers, numbered from 1."""
    return of_seeds(spark.range(1, n + 1).select(F.col("id").alias("seed")))


def of_seeds(seeds: DataFrame) -> DataFrame:
    """A dossier with its facts and expected outcomes for each row (seed); the same number always gives the same dossier."""
    at = F.pmod(F.col("seed"), F.lit(50))
    names = [s for s, (count, _) in SCENARIOS.items() for _ in range(count)]
    d = lambda x: F.lit(x).cast("decimal(4,2)")
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    df = seeds.select("seed").withColumn("scenario", F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")))
    df = df.withColumn("application_id", F.format_string("APP-%05d", "seed")).withColumn("full_name", F.concat_ws(" ", _pick(FIRST, F.col("seed")), _pick(LAST, F.floor(F.col("seed") / 3))))
    df = df.withColumn("gross", money(F.lit(40000) + (F.col("seed") * 1375) % 90000)).withColumn("net", money(F.col("gross") * d("0.82")))
    off_bank, off_tax = F.col("scenario").isin("salary_mismatch", "bank_mismatch", "multiple_inconsistencies"), F.col("scenario").isin("tax_mismatch", "multiple_inconsistencies")
    df = df.withColumn("credit", money(F.when(off_bank, F.col("net") * d(LOW_CREDIT)).otherwise(F.col("net")))).withColumn("itr", F.when(F.col("scenario") != "missing_itr", money(F.when(off_tax, F.col("gross") * 12 * d(LOW_TAX)).otherwise(F.col("gross") * 12))))
    df = df.withColumn("credits", F.array_repeat("credit", 3)).withColumn("opening", F.lit(OPENING).cast("decimal(18,2)")).withColumn("debit", money(F.col("credit") * 3 * d(SPENT)))
    df = df.withColumn("closing", (F.col("opening") + F.col("credit") * 3 - F.col("debit")).cast("decimal(18,2)"))
    df = df.withColumn("payslip_name", F.when(F.col("scenario").isin("identity_mismatch", "multiple_inconsistencies"), "Vikram Joshi").otherwise(F.col("full_name")))
    df = df.withColumn("pan", F.format_string("ABCDE%04dF", F.pmod(F.col("seed"), F.lit(10000))))
    kinds = F.concat(F.array(F.lit("application_form"), F.lit("bank_statement"), F.lit("id_card")), F.when(F.col("scenario") != "missing_payslip", F.array_repeat(F.lit("payslip"), 3)).otherwise(F.array().cast("array<string>")), F.when(F.col("scenario") != "missing_itr", F.array(F.lit("itr"))).otherwise(F.array().cast("array<string>")))
    expected = F.create_map(*[x for r in RULES for x in (F.lit(r), _expected(r))])
    return df.withColumn("documents", kinds).withColumn("expected", expected)


def _expected(rule: str) -> Column:
    out = F.lit("pass")
    for name, (_, odd) in SCENARIOS.items():
        if rule in odd:
            out = F.when(F.col("scenario") == name, odd[rule]).otherwise(out)
    return out


def page_texts(dossiers_: DataFrame) -> DataFrame:
    """(application_id, label, text): a page of each kind, in our own wording."""
    m = lambda c: F.format_number(c, 2)
    kinds = {
        "payslip": F.concat(F.lit("Salary slip\nEmployee Name: "), F.col("payslip_name"), F.lit("\nGross Salary: INR "), m("gross"), F.lit("\nNet Salary: INR "), m("net")),
        "bank_statement": F.concat(F.lit("Statement of account\nAccount Holder: "), F.col("full_name"), F.lit("\nSALARY CREDIT INR "), m("credit"), F.lit("\nClosing Balance: INR "), m("closing")),
        "tax_acknowledgement": F.concat(F.lit("Income tax return acknowledgement\nName of Assessee: "), F.col("full_name"), F.lit("\nPAN "), F.col("pan"), F.lit("\nGross Total Income: INR "), F.coalesce(m("itr"), F.lit("-"))),
        "id_card": F.concat(F.lit("Identity card\nFull Name: "), F.col("full_name"), F.lit("\nPAN "), F.col("pan")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("label"), v.alias("text")) for k, v in kinds.items()])
    return dossiers_.select("application_id", F.explode(rows).alias("p")).select("application_id", "p.*")
