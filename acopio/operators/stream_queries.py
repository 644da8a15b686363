"""What the trend stream does, on the whole table of events (ST2, ST5, B18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources.readers import table
from ..streaming import intake


def raw_signals(events: DataFrame) -> DataFrame:
    """Events as raw trend signals; what is wrong with some is a stand-in made of their columns."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    similar = F.struct(F.concat(F.lit("P"), u).alias("sku"), F.when(e % 31 == 0, "high").otherwise(F.round(F.lit(0.3) + u % 7 / 10, 1).cast("string")).alias("score"), kind.alias("categoria"))
    return events.select(
        F.when(e % 43 == 0, "").otherwise(F.concat(F.lit("T"), e)).alias("trend_id"), F.when(kind == "click", "de la").otherwise(F.concat(kind, F.lit(" wanted everywhere"))).alias("descripcion"), F.lit("TIKTOK").alias("fuente"),
        F.when(e % 37 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("fecha_deteccion"), F.when(e % 29 == 0, "fast").otherwise(F.lit("12.5")).alias("velocidad_crecimiento"),
        F.when(e % 53 == 0, "sure").otherwise((F.floor(F.col("value") / 60 * 100) / 100).cast("string")).alias("confianza_extraccion"), F.array(similar).alias("similares"))


@query("""WITH s AS (SELECT CASE WHEN event_id % 43 = 0 THEN '' ELSE 'T' || event_id END AS trend_id, event_id AS e, event_type AS kind, CASE WHEN event_id % 53 <> 0 THEN floor(value / 60 * 100) / 100 END AS c FROM events),
f AS (SELECT *, array_to_string(list_filter([CASE WHEN trend_id = '' THEN 'trend_id' END, CASE WHEN e % 37 = 0 THEN 'fecha_deteccion' END, CASE WHEN c IS NULL OR c > 1 THEN 'confianza_extraccion' END], lambda x: x IS NOT NULL), ',') AS faults FROM s),
z AS (SELECT *, CASE WHEN faults <> '' THEN 'rejected_schema' WHEN kind = 'click' THEN 'rejected_stopwords' WHEN c < 0.4 THEN 'manual_review' WHEN e % 29 = 0 OR e % 31 = 0 THEN 'rejected_runtime' ELSE 'processed' END AS state FROM f)
SELECT trend_id, state, CASE WHEN state = 'processed' THEN CASE WHEN c >= 0.8 THEN 'regla_020_trend_signal_alta_confidence' ELSE 'regla_999_fallback' END END AS rule,
CASE WHEN state IN ('rejected_schema', 'rejected_stopwords') THEN 0 WHEN state <> 'processed' THEN c WHEN c >= 0.8 THEN 0.7875 ELSE 0.3 END::DOUBLE AS confidence, faults FROM z""")
def intake_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, B18: the end state of each signal, and the rule that its context fires."""
    return intake.results(raw_signals(table(spark, sf_dir, "events")))


@query("""WITH b AS (SELECT max(ts) - INTERVAL 7 DAY AS t0 FROM events), k AS (SELECT tick, t0 + INTERVAL 1 DAY * tick AS t FROM b, range(8) r(tick))
SELECT tick::INT AS tick, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, event_type, count(*) AS n, round(sum(value), 4) AS value FROM k JOIN events ON ts > t - INTERVAL 36 HOUR AND ts <= t GROUP BY 1, 2, 3""")
def clock_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2: what the last 36 hours hold at each tick of a clock that starts a week before the last event and goes on day by day."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last")).first()["last"]
    if last is None:
        return events.select(F.lit(0).alias("tick"), F.lit("").alias("t"), "event_type", F.lit(0).cast("long").alias("n"), "value").limit(0)
    seen = intake.clock_windows(events, "ts", F.lit(last).cast("timestamp") - F.expr("INTERVAL 7 DAYS"), 8, 24, 36)
    return seen.groupBy("tick", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
