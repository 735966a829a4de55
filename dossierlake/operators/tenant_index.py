"""A search index that is kept: written once, replaced a tenant at a time, and read for the tenants that are asked.

Two tables below a path, both partitioned by tenant: ``passages`` (key, length) and ``postings`` (key, length, term, tf). New
passages of a tenant replace that tenant's partitions by dynamic partition overwrite; no other tenant's files change. A search
filters on the partition column, so only the asked tenants' files are read. A large tenant's rows lie in several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import retrieval

TABLES = ["passages", "postings"]
#: Parts of a tenant's rows that may be written by different tasks.
PARTS = 8
POLICY = "POLICY"


def replaced(passages: DataFrame, path: str, key: str, text: str, tenant: str = "tenant", tenants: list[str] | None = None) -> None:
    """Write the index of the passages' tenants, in place of what the path holds of them; others stay as they are, but for those of ``tenants`` that have no passages any more."""
    named = passages.filter(F.col(tenant).isNotNull()).select(F.col(tenant).cast("string").alias("tenant"), F.col(key).alias("key"), text)
    for name, table in zip(TABLES, retrieval.indexed(named, "tenant", "key", text), strict=True):
        dealt = table.repartition("tenant", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
        dealt.sortWithinPartitions("tenant", *(["term"] if name == "postings" else [])).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(f"{path}/{name}")
    if tenants:
        have = {r.tenant for r in named.filter(F.col("tenant").isin(tenants)).select("tenant").distinct().collect()}  # at most the given ones
        removed(passages.sparkSession, path, [t for t in tenants if t not in have])


def removed(spark: SparkSession, path: str, tenants: list[str]) -> None:
    """Delete the given tenants' partitions."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for name in TABLES:
        for tenant in tenants:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/tenant={escape(tenant)}")
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, path: str, tenants: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The index's tables, of the given tenants or of all."""
    columns = {"passages": ["tenant", "key", "length"], "postings": ["tenant", "key", "length", "term", "tf"]}
    found = []
    for name in TABLES:
        seen = spark.read.parquet(f"{path}/{name}").schema
        named = StructType([StructField("tenant", StringType()) if f.name == "tenant" else f for f in seen])  # names of digits stay as they are
        df = spark.read.schema(named).parquet(f"{path}/{name}").select(*columns[name])
        found.append(df if tenants is None else df.filter(F.col("tenant").isin(tenants)))
    return found[0], found[1]


def search(spark: SparkSession, path: str, queries: DataFrame, query_key: str, query_text: str, k: int, tenants: list[str] | None = None, tenant: str = "tenant", **how) -> DataFrame:
    """(query_key, tenant, key, lex_rank, dense_rank, score, rank): each query's best k passages of its own tenant, as ``retrieval.hybrid`` ranks them."""
    asked = queries.select(query_key, F.col(tenant).cast("string").alias("tenant"), query_text)
    words, posted = read(spark, path, tenants)
    return retrieval.hybrid_over(words, posted, asked, "tenant", "key", query_key, query_text, k, **how)


def dossier_pages(states: DataFrame, key: str, texts: str) -> DataFrame:
    """(key, doc_id, page, text) from a JSON object of documents' texts: a text, a list of pages' texts, or a list of objects with text and page_number.

    Pages without a number count from 1; blank pages and values of other kinds give nothing. The name of the policies is no application's.
    """
    kind = lambda v: F.schema_of_variant(v)
    docs = states.filter(F.upper(F.col(key).cast("string")) != POLICY).select(key, F.explode(F.expr(f"try_variant_get(try_parse_json({texts}), '$', 'map<string,variant>')")).alias("doc_id", "v"))
    pages = docs.withColumn("all", F.when(kind("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))).select(key, "doc_id", F.posexplode("all").alias("i", "p"))
    page_object = kind("p").startswith("OBJECT")
    text: Column = F.when(page_object, F.try_variant_get("p", "$.text", "string")).when(kind("p") == "STRING", F.try_variant_get("p", "$", "string"))
    number = F.coalesce(F.when(page_object, F.try_variant_get("p", "$.page_number", "int")), F.col("i") + 1)
    return pages.select(key, "doc_id", number.alias("page"), F.trim(text).alias("text")).filter("text <> ''")
