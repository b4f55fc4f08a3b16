"""Reading the tables of a folder, and limits for broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a lookup side up to which it is broadcast; beyond, Spark shuffles both sides.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 32_000_000
#: Rows of a task in `dealt`.
TASK_ROWS = 200_000
#: Greatest Arrow batches that go to Python, by setting.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows and `size` bytes as JSON; counting stops one row beyond."""
    one = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    got = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(one), F.lit(0))).first()
    return F.broadcast(df) if got[0] <= rows and got[1] <= size else df


def dealt(df: DataFrame, key: str, rows: int, most: int = TASK_ROWS) -> DataFrame:
    """`df`, of about `rows` rows, dealt by a key to as many tasks as keep one at about `most` rows.

    Spark sizes tasks by compressed bytes; narrow rows compress so well that a task would sort many millions of them. Few rows are left to Spark.
    """
    return df.repartition(-(-rows // most), key) if rows > most else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most the rows and bytes of BATCHES from now on, unless its settings are smaller: rows hold whole texts, and a task's Python has a batch in several copies."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in BATCHES.items():
        if not 0 < size(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))
