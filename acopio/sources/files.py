"""Further sources and sinks: ordered fallbacks, documents, signals, vectors, profiles, query results, settings."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

SIGNAL = "trend_id string, descripcion string, fuente string, fecha_deteccion string, confianza_extraccion double, velocidad_crecimiento double"
SIGNAL_KEYS = ("signals", "trends", "items")
SOURCE_NAMES = ("TIKTOK", "INSTAGRAM", "PINTEREST", "GOOGLE_TRENDS", "OTHER")


def first_available(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first source that is there and has a row; the last one stands in any case."""
    for reader in readers[:-1]:
        try:
            found = reader()
            if not found.isEmpty():
                return found
        except AnalysisException:
            continue
    return readers[-1]()


def first_match(df: DataFrame, condition: Column) -> DataFrame:
    """One row that fits; a LookupError if there is none."""
    found = df.where(condition).limit(1)
    if found.isEmpty():
        raise LookupError(f"no row fits {condition}")
    return found


def export_csv(spark: SparkSession, sql: str, path: str) -> None:
    """S2."""
    spark.sql(sql).write.mode("overwrite").option("header", True).csv(path)


def document_files(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """(file, text) of a folder; empty texts are dropped.

    extract turns a file's bytes into its text (a PDF reader, for example);
    without one the bytes are read as UTF-8.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), "content")

    def read(held: pd.Series) -> pd.Series:
        return held.map(lambda b: None if b is None else extract(bytes(b)))

    text = F.decode("content", "UTF-8") if extract is None else F.pandas_udf(read, "string")("content")
    return files.select("file", text.alias("text")).where(F.length(F.trim("text")) > 0)


def signals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An array of signals, or an object that holds one; (valid ones, rejected ones with the paths of their errors)."""
    raw = spark.read.text(path, wholetext=True).select(F.trim("value", F.lit(" \t\r\n")).alias("v"))
    rows = T.ArrayType(T.StructType.fromDDL(SIGNAL))
    held = F.from_json("v", T.StructType([T.StructField(k, rows) for k in SIGNAL_KEYS]))
    found = F.when(F.col("v").startswith("["), F.from_json("v", rows)).otherwise(F.coalesce(*(held[k] for k in SIGNAL_KEYS)))
    checked = raw.select(F.explode(found).alias("r")).select("r.*").withColumn("errors", signal_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def signal_errors() -> Column:
    """Q10, Q19: paths of what breaks the contract of a signal, in its order."""
    from ..functions.trends import iso_time, strict_source

    source = strict_source(F.col("fuente"))
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim("trend_id"), F.lit("")) == "", "trend_id"), F.when(F.coalesce(F.trim("descripcion"), F.lit("")) == "", "descripcion"), F.when(~F.coalesce(source.isin(*SOURCE_NAMES), F.lit(False)), "fuente"),
        F.when(iso_time(F.col("fecha_deteccion")).isNull(), "fecha_deteccion"), F.when(~F.coalesce(F.col("confianza_extraccion").between(0, 1), F.lit(False)), "confianza_extraccion"), F.when(~F.coalesce(F.col("velocidad_crecimiento") >= 0, F.lit(False)), "velocidad_crecimiento"),
    ))


def vectors(spark: SparkSession, path: str, id_col: str, vec_col: str, dimension: int | None = None) -> DataFrame:
    """Stored vectors; those of another dimension are an error when they are read."""
    out = spark.read.parquet(path)
    return out if dimension is None else out.withColumn(vec_col, F.when(F.size(vec_col) == dimension, F.col(vec_col)).otherwise(F.raise_error(F.concat(F.lit("dimension of "), F.col(id_col).cast("string")))))


def save_vectors(df: DataFrame, path: str) -> None:
    """A job commits whole or not at all."""
    df.write.mode("overwrite").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Recommendations, causal graphs and feedback as lines of JSON."""
    df.write.mode("append").json(path)


def profiles_or_default(known: DataFrame, wanted: DataFrame, key: str, default: dict[str, float]) -> DataFrame:
    """Each wanted operator's profile; missing ones, and missing fields, by default."""
    return wanted.select(key).distinct().join(known, key, "left").select(key, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()))


def catalogue_turtle(catalogue: DataFrame, namespace: str) -> DataFrame:
    """(id, kind, name) as Turtle, one statement a line."""
    quoted = F.regexp_replace(F.regexp_replace("name", r"\\", r"\\\\"), '"', r'\\"')
    return catalogue.select(F.concat(F.lit(f"<{namespace}"), "id", F.lit(f"> a <{namespace}"), "kind", F.lit('> ; <http://www.w3.org/2000/01/rdf-schema#label> "'), quoted, F.lit('" .')).alias("value"))


def settings(source: str | dict, defaults: dict, weights: tuple[str, ...] = (), shares: tuple[str, ...] = ()) -> dict:
    """Settings over defaults, from a dict, JSON or (where PyYAML is there) YAML.

    Unknown names, weights that do not sum to 1 and shares outside 0..1 are errors.
    """
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except ValueError:
            import yaml

            source = yaml.safe_load(source)
    if unknown := set(source or {}) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = defaults | (source or {})
    if weights and abs(sum(out[w] for w in weights) - 1) > 1e-6:
        raise ValueError(f"weights do not sum to 1: {', '.join(weights)}")
    if bad := [s for s in (*weights, *shares) if not 0 <= out[s] <= 1]:
        raise ValueError(f"outside 0..1: {', '.join(bad)}")
    return out
