"""Trend signals as they come in: five end states, the decision context of a signal, hand-over to several outputs (ST2, ST5, B18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..plans.dispatch import dispatch

THRESHOLD = 0.4
STATES = ("rejected_schema", "rejected_stopwords", "manual_review", "rejected_runtime", "processed")
#: What a raw signal has; numbers are still texts.
SIGNAL = "trend_id string, descripcion string, fuente string, fecha_deteccion string, velocidad_crecimiento string, confianza_extraccion string, similares array<struct<sku:string,score:string,categoria:string>>"


def context(signals: DataFrame) -> DataFrame:
    """Signals with the fields of their decision context.

    A signal is a trending product without history of its own: no weeks, stock
    or velocity, a volatility of 0.6, two suppliers, its confidence as that of a
    cold start, and the category of the most similar product.
    """
    sure = F.col("confianza_extraccion").try_cast("double")
    score = F.transform("similares", lambda s: F.struct(s["score"].try_cast("double").alias("score"), s["sku"].alias("sku"), s["categoria"].alias("categoria")))
    best = F.reduce("ranked", F.get("ranked", F.lit(0)), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    held = signals.withColumn("ranked", score).withColumn("best", best)
    return held.withColumns({
        "tipo_sku": F.lit("trending"), "nombre": F.substring("descripcion", 1, 80), "categoria": F.coalesce("best.categoria", F.lit("")), "semanas_historia": F.lit(0), "cantidad_stock": F.lit(0.0), "velocidad": F.lit(0.0), "volatilidad_forecast": F.lit(0.6),
        "cold_start_confidence": sure, "similar_top_score": F.coalesce("best.score", F.lit(0.0)), "similar_top_sku": F.col("best.sku"), "trend_confidence": sure, "evento_dentro_de_lead_time": F.lit(False), "proveedores_disponibles": F.lit(2),
    }).drop("best")


def _faults() -> Column:
    """What breaks the contract of a signal."""
    sure = F.col("confianza_extraccion").try_cast("double")
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim("trend_id"), F.lit("")) == "", "trend_id"), F.when(F.col("descripcion").isNull(), "descripcion"), F.when(F.try_to_timestamp("fecha_deteccion").isNull(), "fecha_deteccion"),
        F.when(~F.coalesce(sure.between(0, 1), F.lit(False)), "confianza_extraccion"),
    ))


def results(signals: DataFrame, threshold: float = THRESHOLD, blocked: Column | None = None) -> DataFrame:
    """ST5: trend_id, state, rule and confidence of each signal; works on a stream as on a table.

    In order: a broken contract (rejected_schema), a description of stop words
    (rejected_stopwords), a confidence under the threshold (manual_review), a
    context whose numbers cannot be read (rejected_runtime), and what the rules
    decide (processed).
    """
    held = context(signals).withColumn("faults", _faults())
    unread = F.col("velocidad_crecimiento").try_cast("double").isNull() | F.exists("ranked", lambda s: s["score"].isNull())
    state = F.when(F.size("faults") > 0, STATES[0]).when(X.empty_description(F.col("descripcion")), STATES[1]).when(F.col("trend_confidence") < threshold, STATES[2]).when(F.coalesce(unread, F.lit(True)), STATES[3]).otherwise(STATES[4])
    decided = dispatch(held.withColumn("state", state), blocked=blocked)
    done = F.col("state") == STATES[4]
    sure = F.when(F.col("state").isin(*STATES[:2]), 0.0).when(done, F.col("confidence")).otherwise(F.col("trend_confidence"))
    return decided.select("trend_id", "state", F.when(done, F.col("rule")).alias("rule"), sure.alias("confidence"), F.array_join("faults", ",").alias("faults"))


def run(stream: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Every batch's results go to three outputs of folder: results, alerts (manual review) and audit (processed).

    A batch writes folders of its own number and overwrites them when it runs
    again, so each output has each signal of a batch once, whatever was done
    when a run ended.
    """

    def hand_over(batch: DataFrame, number: int) -> None:
        out = results(batch, **options).persist()
        for name, part in (("results", out), ("alerts", out.where(F.col("state") == STATES[2])), ("audit", out.where(F.col("state") == STATES[4]))):
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        out.unpersist()

    return stream.writeStream.foreachBatch(hand_over).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clock_windows(posts: DataFrame, at: str, start: Column, steps: int, step_hours: int = 24, window_hours: int = 24) -> DataFrame:
    """ST2: posts with tick and t, once for each tick t = start + tick * step_hours (0 .. steps - 1) of a clock whose window (t - window_hours, t] they are in.

    A post's ticks follow from its time, so nothing is compared with the clock.
    """
    micro, step, wide = F.unix_micros(F.col(at).cast("timestamp")), step_hours * 3_600_000_000, window_hours * 3_600_000_000
    since = micro - F.unix_micros(start)
    first = F.greatest(F.lit(0), F.ceil(since / step)).cast("int")
    last = F.least(F.lit(steps - 1), F.ceil((since + wide) / step) - 1).cast("int")
    ticks = posts.withColumn("tick", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return ticks.withColumn("t", F.timestamp_micros(F.unix_micros(start) + F.col("tick").cast("long") * step))
