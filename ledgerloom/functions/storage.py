"""Folders for tables that operators write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a temporary folder, but only in local mode: machines of a cluster don't share such folders."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        top = sc.getCheckpointDir()
    return f"{top}/{name}-{uuid.uuid4().hex}"


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, sorted; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def committed(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(number, names) of the newest manifest at `path`; (0, []) if there is none. Manifests that weren't finished don't count."""
    done = [n for n in folder_names(spark, f"{path}/manifests") if n.isdigit() and "_SUCCESS" in folder_names(spark, f"{path}/manifests/{n}")]
    if not done:
        return 0, []
    return int(done[-1]), [r[0] for r in spark.read.schema("name string, n int").parquet(f"{path}/manifests/{done[-1]}").orderBy("n").collect()]


def commit(spark: SparkSession, path: str, number: int, names: list[str]) -> None:
    """Makes `names` the content at `path` in one step. Fails if that manifest exists already, so of two writers one loses."""
    spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, n int").coalesce(1).write.mode("error").parquet(f"{path}/manifests/{number:010d}")


def saved(df, name: str):
    """`df` written once below the shared folder, and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
