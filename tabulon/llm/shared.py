"""Shared folder, lineage cuts and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset, as in tests on one machine, a local folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a path that new_dir gave."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, what: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there, so a
    lost executor costs a re-read and not the work before. ``batch_rows``: rows that Python
    gets at once meanwhile, where rows are wide."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, batch_rows)
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` gave and nothing reads any more."""
    for df in tables:
        if df is not None:
            drop_dir(df.sparkSession, df._written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table with few columns, to be sent to all executors if it has few rows; else
    joined by shuffle. So what it is joined to isn't dealt by a key that most rows may have."""
    return F.broadcast(table) if table.count() <= rows else table


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with _rank (from 0) in ``order`` and, for each of ``sums``, its sum over the rows
    before. Rows are sorted in ranges: a task holds a range, and one row a range is summed up."""
    d = written(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftrightunsigned("_id", 33))
    inside = Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    all_sums = {"_rank": F.lit(1), **sums}
    per = d.groupBy("_p").agg(*[F.sum(e).alias(k) for k, e in all_sums.items()])
    per = per.select("_p", *[F.coalesce(F.sum(k).over(ranges), F.lit(0)).alias(f"_before{k}") for k in all_sums])
    for k, e in all_sums.items():
        d = d.withColumn(k, F.coalesce(F.sum(e).over(inside), F.lit(0)))
    d = d.join(F.broadcast(per), "_p")
    return d.select(*df.columns, *[(F.col(k) + F.col(f"_before{k}")).alias(k) for k in all_sums])


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_of_id(col):
    """CRC-32 of an id written as decimal text."""
    return F.crc32(F.encode(col.cast("string"), "UTF-8"))


def schema_with(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """df's schema and further columns, each as (name, type)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in more)).fields])


_caches: dict[str, dict] = {}


def worker_cache(of: str) -> dict:
    """What a worker keeps between the tasks of one operator; it holds one operator's at a time."""
    if of not in _caches:
        _caches.clear()
        _caches[of] = {}
    return _caches[of]
