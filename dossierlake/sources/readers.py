"""Sources and sinks: dossier manifests, policies, CSV, questions, binary files, JSON export, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_D = "DECIMAL(18,2)"
MANIFEST = (
    "application_id STRING, seed INT, scenario STRING, split STRING, expected_documents ARRAY<STRING>, generated_document_names ARRAY<STRING>, "
    "applicant_facts STRUCT<full_name: STRING, dob: STRING, pan_number: STRING, aadhaar_masked: STRING, employer_name: STRING>, "
    f"financial_ground_truth STRUCT<gross_monthly_salary: {_D}, net_monthly_salary: {_D}, deductions_total: {_D}, annualized_gross_income: {_D}, bank_monthly_salary_credit: {_D}, "
    f"bank_opening_balance: {_D}, bank_total_credits: {_D}, bank_total_debits: {_D}, bank_closing_balance: {_D}, itr_gross_total_income: {_D}, total_tax_paid: {_D}>, "
    "expected_rule_outcomes MAP<STRING, STRING>, applicant_name STRING, injected_anomaly STRING, "
    f"payslip STRUCT<employee_name: STRING, employer_name: STRING, gross_salary: {_D}, net_salary: {_D}, epf_deduction: {_D}, tds_deduction: {_D}>, "
    f"bank_statement STRUCT<account_holder: STRING, bank_name: STRING, account_number: STRING, monthly_salary_credits: ARRAY<{_D}>, average_balance: {_D}, bounced_transactions: INT>, "
    f"tax_return STRUCT<assessee_name: STRING, pan_number: STRING, gross_total_income: {_D}, total_tax_paid: {_D}>, kyc STRUCT<full_name: STRING, pan_number: STRING, dob: STRING, aadhaar_masked: STRING>"
)
SEED_CSV = "loan_id INT, no_of_dependents INT, education STRING, self_employed STRING, income_annum DOUBLE, loan_amount DOUBLE, loan_term INT, cibil_score INT, residential_assets_value DOUBLE, commercial_assets_value DOUBLE, luxury_assets_value DOUBLE, bank_asset_value DOUBLE, loan_status STRING"
QUESTIONS = "id STRING, split STRING, application_id STRING, question STRING, expected_fact STRING, ground_truth_answer STRING, expected_citations ARRAY<STRING>"
#: Leading bytes by media type.
SIGNATURES = {"application/pdf": "25504446", "image/png": "89504E47", "image/jpeg": "FFD8FF"}
MAX_UPLOAD = 10 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan gives fewer parts than there are; inputs of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Dossier manifests, one JSON object a file; keys that older ones lack are null."""
    return spark.read.schema(MANIFEST).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def manifest_chunks(manifests_: DataFrame) -> DataFrame:
    """Five passages of text a dossier: income, bank, tax, identity and rules."""
    g, a = "financial_ground_truth", "applicant_facts"
    m = lambda c: F.coalesce(F.format_number(F.col(f"{g}.{c}"), 2), F.lit("UNKNOWN"))
    s = lambda c: F.coalesce(F.col(f"{a}.{c}"), F.lit("UNKNOWN"))
    parts = {
        "payslip": F.concat(F.lit("Gross monthly salary INR "), m("gross_monthly_salary"), F.lit(", net monthly salary INR "), m("net_monthly_salary"), F.lit(", deductions INR "), m("deductions_total")),
        "bank": F.concat(F.lit("Monthly salary credit INR "), m("bank_monthly_salary_credit"), F.lit(", closing balance INR "), m("bank_closing_balance")),
        "tax": F.concat(F.lit("Gross total income INR "), m("itr_gross_total_income"), F.lit(", tax paid INR "), m("total_tax_paid")),
        "identity": F.concat(F.lit("Applicant "), s("full_name"), F.lit(", born "), s("dob"), F.lit(", employed by "), s("employer_name")),
        "rules": F.concat(F.lit("Expected outcomes: "), F.array_join(F.transform(F.array_sort(F.map_entries("expected_rule_outcomes")), lambda e: F.concat(e["key"], F.lit(" "), e["value"])), ", ")),
    }
    rows = F.array(*[F.struct(F.concat(F.col("application_id"), F.lit(f"_{k}")).alias("chunk_id"), v.alias("text")) for k, v in parts.items()])
    return manifests_.select("application_id", F.explode(rows).alias("c")).select("application_id", "c.*")


def policies(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the Markdown files of a folder."""
    return spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))


def seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Applicants with the header's blanks and byte-order mark removed; a row that doesn't fit the types is an error."""
    df = spark.read.schema(SEED_CSV).option("header", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("enforceSchema", True).csv(path)
    assets = sum((F.col(c) for c in ("residential_assets_value", "commercial_assets_value", "luxury_assets_value", "bank_asset_value")), F.lit(0.0))
    return df.drop("loan_status").withColumn("assets_total", assets)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, media_type, accepted): files judged by their leading bytes and size. Spark's scan leaves empty files out, so they give no row."""
    kind = F.lit(None).cast("string")
    head = F.hex(F.substring("content", 1, 8))
    for media, mark in SIGNATURES.items():
        kind = F.when(head.startswith(mark), media).otherwise(kind)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), kind.alias("media_type"), (kind.isNotNull() & (F.col("length") <= MAX_UPLOAD)).alias("accepted"))


def storage_key(*parts: Column | str) -> Column:
    return F.concat_ws("/", *parts)


def valid_key(key: Column | str, tenant: Column | str) -> Column:
    """A key of safe characters without parent steps, below its tenant."""
    k = F.col(key) if isinstance(key, str) else key
    t = F.col(tenant) if isinstance(tenant, str) else tenant
    return k.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/-]*$") & ~k.contains("..") & ~k.contains("//") & k.startswith(F.concat(t, F.lit("/")))


def to_json(df: DataFrame, *, drop: tuple[str, ...] = ()) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in drop])).alias("json"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; of several new ones, the last by all columns."""
    last = new.groupBy(key).agg(F.max(F.struct(*new.columns)).alias("_r")).select("_r.*")
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def write(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").partitionBy(*parts).parquet(path) if parts else df.write.mode("overwrite").parquet(path)
