"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes shuffle files when a statement has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Paths of the tables in the shared folder, for `remove_written`.
TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` doesn't have (case-insensitively), one for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also where `body` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one, but only in local mode: machines of a cluster don't share such folders."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = sc.getCheckpointDir()
    return named


def written(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder, and read again: it cuts the lineage and survives lost executors.

    The shuffle files behind it are needed no more, so Spark is asked to remove them when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    TABLES.append(path)
    was = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Deletes all tables that `written` has made in this Python process, and returns their number. Call it when the results that read them are stored."""
    jvm = spark.sparkContext._jvm
    for path in TABLES:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    n = len(TABLES)
    TABLES.clear()
    return n


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows in an Arrow batch from now on in this session, unless it has a smaller setting: rows hold whole texts, and Spark's default is for narrow rows."""
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def release() -> None:
    """Gives freed memory back to the system. Python workers live on between stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Size of all texts, one number on the driver."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
