"""Queries that write versioned tables and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources.keyed import KeyedTable
from ..sources.readers import table
from ..sources.shared import shared_folder
from .similarity import _EDGES, edges, undirected


def _new(spark: SparkSession, keys: list[str], buckets: int = 16) -> KeyedTable:
    return KeyedTable(spark, f"{shared_folder(spark)}/acopio/{uuid.uuid4().hex}/table", keys, buckets)


@query(f"WITH {_EDGES}, u AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(score, 4) AS score FROM edges) SELECT a, b, score, CASE WHEN score >= 0.5 THEN 2 ELSE 1 END AS version FROM u")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: similarity edges, loaded after everything was deleted, those of 0.5 and more merged a second time."""
    found = undirected(edges(spark, sf_dir)).select("a", "b", F.round("score", 4).alias("score"))
    held = _new(spark, ["a", "b"])
    held.merge(spark.createDataFrame([(-1, -2, 0.0, 0)], "a long, b long, score double, version int"))
    held.delete()
    held.merge(found.withColumn("version", F.lit(1)))
    held.merge(held.read().where("score >= 0.5").withColumn("version", F.lit(2)))
    return held.read()


@query("""WITH c AS (SELECT doc_id, i::INT AS chunk, trim(substr(text, i * 700 + 1, 800), ' ') AS t, length(text) AS n FROM (SELECT doc_id, text, unnest(range((length(text) + 699) // 700)) AS i FROM documents WHERE length(text) > 800) UNION ALL SELECT doc_id, 0, trim(text, ' '), length(text) FROM documents WHERE length(text) <= 800)
SELECT doc_id, chunk, sha256(CASE WHEN doc_id % 10 = 0 THEN 'v2 ' || t ELSE t END) AS chunk_sha256, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version FROM c WHERE t <> '' AND doc_id % 7 <> 3""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks under (document, place): all are stored, every tenth document's anew, every seventh's deleted."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk", "chunk_text"))
    held = _new(spark, ["doc_id", "chunk"])
    held.merge(chunks.withColumn("version", F.lit(1)))
    held.merge(chunks.where("doc_id % 10 = 0").withColumns({"chunk_text": F.concat(F.lit("v2 "), "chunk_text"), "version": F.lit(2)}))
    held.delete(chunks.where("doc_id % 7 = 3"))
    return held.read().select("doc_id", "chunk", F.sha2("chunk_text", 256).alias("chunk_sha256"), "version")


@query("""WITH d AS (SELECT user_id, ts::DATE AS day, round(avg(value), 6) AS level, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, day, level, n FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1""")
def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile for each user, overwritten by each later day's, of one merge with several days the last one wins."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("level"), F.count(F.lit(1)).alias("n"))
    held = _new(spark, ["user_id"])
    middle = days.agg(F.expr("date_add(min(day), cast(datediff(max(day), min(day)) div 2 as int))").alias("d")).first()["d"]
    held.merge(days.where(F.col("day") <= F.lit(middle)), order=["day"])
    held.merge(days.where(F.col("day") > F.lit(middle)), order=["day"])
    return held.read()
