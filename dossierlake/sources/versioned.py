"""A table that streams are merged into: each batch is a version, and a batch that comes again changes nothing.

Rows lie in buckets of their key's hash. A batch rewrites only the buckets that it touches, below its own number, and counts
once its commit is written after them. Readers take each bucket's last committed batch, so a batch that broke off is never
seen, and one that is repeated is skipped or writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .shared import exists

BUCKETS = 64


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/commits").select(F.col("number").cast("long").alias("batch")) if exists(spark, f"{path}/commits") else None


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows after its last committed batch."""
    done = _committed(spark, path)
    if done is None:
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
    rows = spark.read.schema(whole).parquet(f"{path}/data")
    last = rows.select("batch", "bucket").distinct().join(done, "batch", "left_semi").groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["bucket", "batch"], "left_semi").select(*schema.names)


def merge_batch(batch: DataFrame, number: int, path: str, key: str, order: list[str], buckets: int = BUCKETS) -> None:
    """Lay a batch's rows over the table's: of a key's rows in the batch, the last by ``order`` (ties: by all columns) takes its place."""
    spark = batch.sparkSession
    done = _committed(spark, path)
    if done is not None and done.filter(F.col("batch") == number).head(1):
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    row = F.struct(*batch.columns)
    new = batch.groupBy(key).agg(F.max_by(row, F.struct(*order, *[c for c in batch.columns if c not in order])).alias("_r")).select("_r.*").withColumn("bucket", bucket).persist()
    old = latest(spark, path, batch.schema).withColumn("bucket", bucket).join(new.select("bucket").distinct(), "bucket", "left_semi")
    merged = old.select(*batch.columns, "bucket").join(new.select(key), key, "left_anti").select(*batch.columns, "bucket").unionByName(new)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={number}")
    spark.range(number, number + 1).select(F.col("id").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={number}")
    new.unpersist()


def merged_stream(rows: DataFrame, path: str, key: str, order: list[str], checkpoint: str, buckets: int = BUCKETS):
    """A started query that merges a stream's batches."""
    return rows.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, number, path, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
