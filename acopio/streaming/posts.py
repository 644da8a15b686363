"""Streams of posts and events: windows, deduplication, trend batches, operator state (ST1-ST9).

Watermarks and session windows go beyond the batch semantics and serve late
data only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed(events: DataFrame, hours: int = 24, late: str = "2 days") -> DataFrame:
    """ST1: counts by (t - h, t] windows; Spark's are [t, t + h), so times move back one microsecond."""
    moved = events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
    out = moved.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.end").alias("t"), "event_type", "n", "value")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """ST8: each id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def amplified(posts: DataFrame, id_col: str, post: int, factor: float = 1.5) -> DataFrame:
    """ST3: one post's value grows."""
    return posts.withColumn("value", F.when(F.col(id_col) == post, F.col("value") * factor).otherwise(F.col("value")))


def profiles(events: DataFrame) -> DataFrame:
    """ST9: a versioned confidence for each user, kept as state."""
    steps = {"purchase": 0.03, "click": -0.06, "view": 0.02}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, version = state.get if state.exists else (0.5, 1)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            level, version = min(1.0, max(0.0, level + steps.get(kind, 0.0))), version + 1
        state.update((level, version))
        yield pd.DataFrame({"user_id": [key[0]], "confidence": [level], "version": [version]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, confidence double, version long", "confidence double, version long", "update", GroupStateTimeout.NoTimeout)


def run_batches(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    """ST4, ST6, ST7: each available batch goes through a batch pipeline; exactly once for idempotent handlers."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
