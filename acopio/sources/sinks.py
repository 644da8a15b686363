"""Sinks: keyed upserts, append-only logs, triple files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new replace rows of old with the same keys.

    Of rows of new with the same keys the last by order wins, and of equal
    ones, or without an order, the one with the largest values.
    """
    others = [c for c in new.columns if c not in keys]
    if others:
        row = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(others)))
        last = new.groupBy(*keys).agg(F.max(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order or [])), row.alias("row"))).alias("__last"))
        new = last.select(*keys, *(F.col(f"__last.row.c{k}").alias(c) for k, c in enumerate(others))).select(*new.columns)
    else:
        new = new.distinct()
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K4: how many keys of new are created and updated."""
    known = old.select(*keys).distinct().withColumn("known", F.lit(1))
    return new.select(*keys).distinct().join(known, keys, "left").agg(F.count_if(F.col("known").isNull()).alias("created"), F.count_if(F.col("known").isNotNull()).alias("updated"))


def link_to_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_ref: str, parent_key: str) -> DataFrame:
    """K2: edges of children whose parent is set and exists."""
    return child.where(F.col(parent_ref).isNotNull()).join(parent.select(F.col(parent_key).alias(parent_ref)), parent_ref, "left_semi").select(child_key, parent_ref).dropDuplicates()


def append_new(path: str, rows: DataFrame, key: str, known: DataFrame | None) -> None:
    """K9, K10, ST8: append rows whose key is not known yet."""
    fresh = rows.dropDuplicates([key])
    fresh = fresh if known is None else fresh.join(known.select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text for each row, nulls left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def literal(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def ntriples(triples: DataFrame) -> DataFrame:
    """K6: (s, p, o, o_kind, datatype) as lines of N-Triples."""
    object_ = F.when(F.col("o_kind") == "uri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(literal(F.col("o")), F.coalesce(F.concat(F.lit("^^<"), "datatype", F.lit(">")), F.lit(""))))
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), object_, F.lit(" .")).alias("value"))


def backfill_uri(df: DataFrame, uri: str, namespace: str, label: str, key: str) -> DataFrame:
    """K20."""
    return df.withColumn(uri, F.coalesce(F.col(uri), F.concat(F.lit(f"{namespace}{label}/"), F.col(key).cast("string"))))
