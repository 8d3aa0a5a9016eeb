"""Intermediate tables in the folder that every executor shares.

A staged table cuts lineage the way ``checkpoint()`` does, but stays columnar and
compressed.  The folder is the one the cluster names in ``spark.checkpoint.dir``; only a
local session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task sorts or hashes, where tables are dealt by ``task_count``.
TASK_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a local one only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def task_count(rows: DataFrame) -> int:
    """Partitions for ``rows``, which are counted: the session's, or more, so that a task has about ``TASK_ROWS``."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
