"""What the operators of this subpackage share: shared scratch tables, safe batches, connected components."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows up to which a side of long ids may be broadcast (about 50 MB as a hash table); beyond, joins shuffle.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch for columns of texts.
TEXT_BATCH = 512
#: Whether a query's shuffle files are deleted once it has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: str | None = None
_within: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir of the session. Where that is unset, a master in one process has a local one; a cluster raises."""
    global _own
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = have.get() if have.isDefined() else None
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="dossierlake-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        at = "file://" + _own
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), spark.sparkContext.applicationId, *_within, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch tables that are made within go when it ends; what outlasts them must be written elsewhere before."""
    _within.append(f"within-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{'/'.join(_within)}")
        _within.pop()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _write(df: DataFrame, path: str) -> None:
    """Write a table whose shuffle files go with the job, as nothing else reads them; Spark's own way waits for the driver's garbage collection."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts lineage, and survives the loss of executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, *more) -> tuple:
    """A scratch table, its number of rows and further aggregates, which Spark observes while it writes, without another job."""
    spark, path, seen = df.sparkSession, scratch_path(df.sparkSession, name), Observation()
    _write(df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(more)]), path)
    got = seen.get
    return spark.read.schema(df.schema).parquet(path), got.get("n") or 0, *[got.get(f"m{i}") for i in range(len(more))]


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a scratch table that no later result reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(spark, folder)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once no result that was made from them is read any more."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows for this session, unless it already asks for fewer. Queries and the pipeline choose it for their
    sessions, as Spark's usual batches of up to 64 MB take several times that in each worker; operators leave the session alone."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH:
        spark.conf.set(key, TEXT_BATCH)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or as many underscores after it as make it no column of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a table that its caller has bounded, in one task: its arrays are the worker's, and only the model reaches the driver."""
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit(pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = rows.mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else fit(schema.empty_table())


def schema_with(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` and further columns; a copy, as StructType.add changes the original."""
    added = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items()))
    return StructType([*df.schema.fields, *added.fields])


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted rows of ids are within the bound; else the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b long): component is the smallest node that can be reached.

    Large-star and small-star steps in turn until nothing changes, each a group minimum and an equi-join; the
    number of rounds grows with the logarithm of a component's size. Nothing reaches the driver but a count and a checksum.
    """
    edges, many = counted(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    while many:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("k"), F.least("a", "low").alias("low"))
        star = both.join(low, both.a == low.k).filter("b > a and b <> low").select(F.col("low").alias("a"), "b").distinct()
        # small star: each node's lower neighbours, and the node itself, go to the lowest of them
        low = star.groupBy("b").agg(F.min("a").alias("low")).withColumnRenamed("b", "k")
        down = star.join(low, star.b == low.k)
        star = down.filter("a <> low").select(F.col("low").alias("x"), F.col("a").alias("y")).union(low.select("low", "k")).toDF("a", "b").distinct()
        edges, *now = counted(star, "edges", F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if now == before:
            break
        before = now
    out = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return out.union(edges.select("a", "a").distinct())


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) once ``links`` (a, b) have joined some of them; ``comps`` need not hold nodes that are alone."""
    own = lambda c: links.select("a", "b").join(comps.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    links = own("a")
    new = components(own("b").select("a", "b"))
    old = comps.join(new.withColumnRenamed("component", "low"), F.col("component") == new["node"], "left").select(comps["node"], F.coalesce("low", "component").alias("component"))
    return old.unionByName(new.join(comps.select("node"), "node", "left_anti"))
