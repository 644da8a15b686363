"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where a local session names none (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="acopio-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def tasks_for(spark: SparkSession, rows: int, held: int = 200_000) -> int:
    """Into how many tasks to deal so many rows, for about held rows each: shuffle partitions at least.

    repartition(n, keys) with this number bounds what sorts and aggregations of
    a task hold, however large a file split is and however well a key
    compresses; adaptive execution does not merge what has a number.  The
    count of a table comes from its files' footers.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // held))


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: later steps reread it, and none recomputes it."""
    path = f"{shared_folder(df.sparkSession)}/acopio/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
