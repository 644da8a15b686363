"""Shapes: what records must have, as conditions and messages (Q3-Q5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: message -> SQL condition that a record keeps; a null condition is broken.
SUPPLIER = {"no id": "length(cast(id as string)) > 0", "country is not two capitals": "country rlike '^[A-Z]{2}$'"}
NORM = {"priority is not in 0..100": "priority between 0 and 100", "valid from is after valid to": "valid_from is null or valid_to is null or valid_from <= valid_to", "no modality": "modality in ('Obligation', 'Permission', 'Prohibition')"}
DECISION = {"no time": "at is not null", "no algorithm": "algorithm is not null", "reasoning under ten characters": "length(reasoning) >= 10"}


def violations(records: DataFrame, shape: str, id_col: str, rules: dict[str, str]) -> DataFrame:
    """(shape, node, message) for each condition that a record breaks."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(kept), F.lit(False)), message) for message, kept in rules.items())))
    return records.select(F.lit(shape).alias("shape"), F.col(id_col).cast("string").alias("node"), F.explode(broken).alias("message"))
