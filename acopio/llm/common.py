"""What the operators share: table reading, shared storage, text keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master (tests, notebooks) may name none: a temporary folder
    is set then.  On a cluster that folder would be another on each machine,
    so there it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = sc.getCheckpointDir()
    if not held:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="acopio-"))
        held = sc.getCheckpointDir()
    return held.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread and not a recomputation, and no later
    step depends on how an earlier one was partitioned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/acopio/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, label: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """materialise(), and aggregates of what was written, taken by the same job."""
    seen = Observation()
    out = materialise(df.observe(seen, *(c.alias(k) for k, c in counts.items())), label)
    return out, {k: v or 0 for k, v in seen.get.items()}


def drop_materialised(df: DataFrame) -> None:
    """Delete the files behind a frame that materialise() returned."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def key128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds: equal for equal values only."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)


def eq_null(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
