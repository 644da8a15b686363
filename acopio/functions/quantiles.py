"""Continuous quantiles from counts by value, to the last bit those that SQL's quantile_cont gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the product's rounding error, by splitting both factors, is added back."""

    def halves(x: Column) -> tuple[Column, Column]:
        t = x * 134217729.0
        high = t - (t - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    lost = F.nanvl(((ah * bh - p) + ah * bl + al * bh) + al * bl, F.lit(0.0))
    s = p + c
    back = s - p
    return s + F.nanvl((p - (s - back)) + (c - back) + lost, F.lit(0.0))


def ranked(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """counts with what quantile() needs: the non-null rows of a group up to each value, and all of them."""
    held = F.when(F.col(value).isNotNull(), F.col(n)).otherwise(0)
    w = Window.partitionBy(*keys)
    return counts.withColumn("upto", F.sum(held).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all", F.sum(held).over(w))


def quantile(value: str, share: float) -> Column:
    """Aggregate over ranked(): the quantile, interpolated between two values."""
    at = (F.col("all") - 1) * F.lit(share)
    low, high = (F.min(F.when(F.col("upto") > f(at), F.col(value).cast("double"))) for f in (F.floor, F.ceil))
    d = F.max(at - F.floor(at))
    return F.when(d == 0, low).otherwise(fused(low, 1 - d, high * d))
