"""The trend stream against the same work on a table, after restarts; the clock; Turtle folders."""

import datetime

import pytest
from pyspark.sql import functions as F

from acopio.operators.stream_queries import raw_signals
from acopio.sources.graph import turtle, turtle_faults
from acopio.sources.readers import table
from acopio.streaming import intake

DIR = "/root/testdata/sf0.001"


def test_stream_equals_the_batch_after_restarts(spark, tmp_path):
    events = table(spark, DIR, "events")
    signals = raw_signals(events)
    for k in range(3):
        signals.where(F.expr(f"coalesce(try_cast(substring(trend_id, 2) as int), 0) % 3 = {k}")).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"
    calls = []

    def breaks(batch, number):
        """The first run ends after its outputs were half written."""
        calls.append(number)
        intake.results(batch).limit(1).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        raise RuntimeError("the executor is lost")

    query = stream().writeStream.foreachBatch(breaks).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    for _ in range(2):  # the second run finds nothing new
        intake.run(stream(), out, f"{tmp_path}/ckpt").awaitTermination()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.drop("batch").collect())
    want = intake.results(signals)
    assert rows(spark.read.parquet(f"{out}/results")) == rows(want) and calls
    assert rows(spark.read.parquet(f"{out}/alerts")) == rows(want.where("state = 'manual_review'"))
    assert rows(spark.read.parquet(f"{out}/audit")) == rows(want.where("state = 'processed'"))
    assert {r["state"] for r in want.select("state").distinct().collect()} == set(intake.STATES)


def test_context_and_states(spark):
    ok = [("P1", "0.4", "a"), ("P2", "0.9", "b"), ("P3", "0.9", "c")]
    rows = [
        ("T1", "red shoes everywhere", "TIKTOK", "2026-01-01", "3", "0.9", ok), ("T2", "red shoes everywhere", "TIKTOK", "2026-01-01", "fast", "0.9", ok), ("T3", "red shoes everywhere", None, "2026-01-01", "3", "0.9", [("P1", "x", "a")]),
        ("T4", "de la", "TIKTOK", "2026-01-01", "3", "0.9", ok), ("T5", "red shoes everywhere", "TIKTOK", "2026-01-01", "3", "0.39", None), (None, None, None, None, None, None, None), ("T7", "red shoes everywhere", "TIKTOK", "2026-01-01", "3", "0.5", []), ("T8", "red shoes everywhere", "TIKTOK", "2026-01-01", "3", "2", ok),
    ]
    signals = spark.createDataFrame(rows, intake.SIGNAL)
    got = {r["trend_id"]: (r["state"], r["faults"]) for r in intake.results(signals).collect()}
    assert got == {"T1": ("processed", ""), "T2": ("rejected_runtime", ""), "T3": ("rejected_runtime", ""), "T4": ("rejected_stopwords", ""), "T5": ("manual_review", ""), None: ("rejected_schema", "trend_id,descripcion,fecha_deteccion,confianza_extraccion"), "T7": ("processed", ""), "T8": ("rejected_schema", "confianza_extraccion")}
    held = {r["trend_id"]: r for r in intake.context(signals).collect()}
    assert (held["T1"]["similar_top_sku"], held["T1"]["similar_top_score"], held["T1"]["categoria"]) == ("P2", 0.9, "b")
    assert (held["T7"]["similar_top_sku"], held["T7"]["similar_top_score"], held["T7"]["categoria"], held["T7"]["volatilidad_forecast"]) == (None, 0.0, "", 0.6)
    assert intake.results(signals.where("false")).count() == 0


def test_clock(spark):
    at = lambda h: datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h)
    rows = [(k, at(h)) for k, h in enumerate([-36, -35, -12, 0, 0.5, 12, 24, 100, 167, 168, 169, 400])]
    seen = intake.clock_windows(spark.createDataFrame(rows, "k long, ts timestamp"), "ts", F.lit(at(0)), 8, 24, 36).collect()
    want = {(k, tick) for k, ts in rows for tick in range(8) if at(24 * tick - 36) < ts <= at(24 * tick)}
    assert {(r["k"], r["tick"]) for r in seen} == want and len(seen) == len(want)


def test_turtle_folder(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.ttl").write_text(f"@prefix : <urn:x#> .\n:s{k} :p [ :q {k} ] , ( 1 ) .")
    assert turtle(spark, f"{tmp_path}").count() == 5 * 5
    blanks = {r["s"] for r in turtle(spark, f"{tmp_path}").where("s like '\\_:%'").collect()}
    assert len(blanks) == 10 and turtle_faults(spark, f"{tmp_path}").count() == 0
    (tmp_path / "bad.ttl").write_text(":s :p :o .")
    faults = turtle_faults(spark, f"{tmp_path}").collect()
    assert len(faults) == 1 and faults[0]["file"].endswith("bad.ttl") and "prefix" in faults[0]["error"]
    with pytest.raises(Exception, match="bad.ttl"):
        turtle(spark, f"{tmp_path}").collect()


def test_named_predicates(spark):
    from acopio.plans.norms import PREDICATES, Norm, evaluate, register_predicate

    @register_predicate("large")
    def large():
        return F.col("monto_usd") > 100

    assert register_predicate("large")(large) is large
    with pytest.raises(ValueError):
        register_predicate("large")(lambda: F.lit(True))
    norms = (Norm("F_large", "prohibition", "@large", "compra", 10), Norm("P_all", "permission", "tipo = 'compra'", "otro", 5))
    rows = spark.createDataFrame([(1, "compra", 50.0), (2, "compra", 500.0), (3, "compra", None)], "k int, tipo string, monto_usd double").withColumn("now", F.to_timestamp(F.lit("2026-06-01 00:00:00")))
    assert {r["k"]: r["verdict"] for r in evaluate(rows, norms).collect()} == {1: "permitted", 2: "blocked", 3: "permitted"}
    with pytest.raises(ValueError):
        evaluate(rows, (Norm("F_x", "prohibition", "@nobody", "compra", 10),))
    del PREDICATES["large"]


def test_document_files_with_an_extractor(spark, tmp_path):
    from acopio.sources.files import document_files

    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"")
    assert [tuple(r) for r in document_files(spark, f"{tmp_path}", lambda b: b.decode()[::-1]).collect()] == [("a.bin", "cba")]
