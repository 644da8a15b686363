"""Readers with explicit schemas, and parsers of the micro-formats found in extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEKLY_SALES = T.StructType([T.StructField("sku", T.LongType()), T.StructField("anio", T.IntegerType()), T.StructField("semana", T.IntegerType()), T.StructField("unidades_vendidas", T.LongType()), T.StructField("importe_total_pyg", T.LongType())])
POST = T.StructType([T.StructField("post_id", T.StringType()), T.StructField("platform", T.StringType()), T.StructField("autor", T.StringType()), T.StructField("fecha", T.TimestampType()), T.StructField("texto", T.StringType()), T.StructField("metricas", T.StructType([T.StructField(c, T.LongType()) for c in ("views", "likes", "shares", "comments")]))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A CSV extract; rows that do not fit the schema are dropped."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").csv(path)


def weekly_sales(spark: SparkSession, path: str) -> DataFrame:
    """S4, U5: ';' separated, with a byte order mark; keys must be set and weeks lie in 1..53."""
    rows = spark.read.option("header", True).option("sep", ";").option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*(c.replace("﻿", "") for c in rows.columns))
    if missing := set(WEEKLY_SALES.names) - set(rows.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    typed = rows.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in WEEKLY_SALES))
    return typed.dropna(subset=["sku", "anio", "semana", "unidades_vendidas"]).where(F.col("semana").between(1, 53))


def volume_tiers(text: Column) -> Column:
    """S6: '1000:0.03|2000:0.06' -> array<struct<qty int, pct double>>."""
    parts = F.filter(F.split(text, r"\|"), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("qty"), F.split(x, ":")[1].cast("double").alias("pct")))


def tier_discount(tiers: Column, quantity: Column) -> Column:
    """The largest discount whose quantity is reached, else 0."""
    return F.coalesce(F.array_max(F.transform(F.filter(tiers, lambda t: quantity >= t["qty"]), lambda t: t["pct"])), F.lit(0.0))


def seasonal_vector(text: Column) -> Column:
    """Comma separated numbers; empty ones are left out."""
    return F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("double"))


def event_date(week: Column, start: str = "2026-01-01") -> Column:
    """The first day of a week counted from start."""
    return F.date_add(F.to_date(F.lit(start)), (7 * F.greatest(week - 1, F.lit(0))).cast("int"))


def posts(spark: SparkSession, path: str) -> DataFrame:
    """An array of posts, or an object with posts or items; by event time."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value", F.lit(" \t\r\n")).alias("v"))
    listed = F.from_json("v", T.ArrayType(POST))
    held = F.from_json("v", T.StructType([T.StructField("posts", T.ArrayType(POST)), T.StructField("items", T.ArrayType(POST))]))
    rows = F.when(F.col("v").startswith("["), listed).otherwise(F.coalesce(held["posts"], held["items"]))
    return raw.select(F.explode(rows).alias("p")).select("p.*").orderBy("fecha", "post_id")


def ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples -> (s, p, o, o_kind, datatype, lang)."""
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    part = lambda g: F.regexp_extract("value", r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:\^\^<([^>]*)>|@([\w-]+))?\s*\.\s*$', g)
    return line.select(F.regexp_replace(part(1), "[<>]", "").alias("s"), part(2).alias("p"), F.regexp_replace(part(3), r'^[<"]|[>"]$', "").alias("o"), F.when(part(3).startswith('"'), "literal").otherwise("uri").alias("o_kind"), F.nullif(part(4), F.lit("")).alias("datatype"), F.nullif(part(5), F.lit("")).alias("lang"))
