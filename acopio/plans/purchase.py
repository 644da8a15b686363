"""Purchase plans: supplier scores, ordering algorithms, buffers and caps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_suppliers(candidates: DataFrame, keys: list[str], local: Column | None = None) -> DataFrame:
    """Candidates (supplier, reliability, lead_days, price) with score and place in each group."""
    top = F.max("price").over(Window.partitionBy(*keys))
    score = 0.5 * F.col("reliability") + 0.3 / (1 + F.col("lead_days") / 30) + 0.2 * F.when(top > 0, 1 - F.col("price") / top).otherwise(1.0)
    if local is not None:
        score = score + F.when(local, 0.15).otherwise(0.0)
    scored = candidates.withColumn("score", F.round(score, 9))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "supplier")))


def whole(x: Column) -> Column:
    """Rounded half to even, as an integer."""
    return F.bround(x).cast("long")


def buffered(quantity: Column, factor: Column) -> Column:
    """O26."""
    return whole(quantity * F.greatest(F.lit(1.0), F.coalesce(factor, F.lit(1.0))))


def capped(quantity: Column, price: Column, budget: Column) -> Column:
    """What the budget pays for."""
    return F.when(price > 0, F.least(quantity, F.floor(budget / price))).otherwise(quantity)


def quantities(algorithm: str, service: float = 0.95) -> tuple[Column, Column, Column, float]:
    """p5, central and p95 quantity before buffer and cap, and the share of the forecast's confidence that stays.

    Columns: mean, p5, p50, p95, std (demand of the horizon), perishable,
    confidence; affine_simple also level, slope, weeks.
    """
    mix = min(1.0, max(0.0, (service - 0.5) / 0.45))
    if algorithm == "open_loop":
        return whole(F.col("p5")), whole(F.col("mean")), whole(F.col("p95")), 0.85
    if algorithm == "cold_inherit":
        return whole(F.col("p5") * 0.7), whole(F.col("mean") * 0.7), whole(F.col("p95") * 0.7), 0.7
    if algorithm == "inv_buffer":
        kept = F.when(F.coalesce("perishable", F.lit(False)), 0.85).otherwise(1.0)
        central = (1 - mix) * F.col("p50") + mix * F.col("p95")
        return whole(F.col("p5")), whole(whole(central) * kept), whole(whole(F.col("p95")) * kept), 0.92
    if algorithm == "safety_stock":
        return whole(F.col("p50")), whole(F.col("p95") + (0.5 * F.col("std") if service > 0.95 else F.lit(0.0))), whole(F.col("p95")), 0.85
    if algorithm == "affine_simple":
        tilt = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 + F.col("slope") * 0.1 * F.col("weeks")))
        sure = 0.9 + 0.1 * F.col("confidence")
        return whole(F.col("p5") * sure), whole(F.col("level") * F.col("weeks") * tilt), whole(F.col("p95") * sure), 0.95
    raise ValueError(f"unknown algorithm {algorithm!r}")


def order(items: DataFrame, algorithm: str, service: float = 0.95) -> DataFrame:
    """Items with quantities, cost and the risk of the interval.

    Items also have price, budget and buffer (a factor or null).
    """
    low, central, high, stays = quantities(algorithm, service)
    q = capped(buffered(central, F.col("buffer")), F.col("price"), F.col("budget"))
    out = items.withColumn("quantity", q.cast("long")).withColumn("quantity_p5", F.least(low, F.col("quantity"))).withColumn("quantity_p95", F.greatest(buffered(high, F.col("buffer")), F.col("quantity")))
    over, under = F.col("price") * (F.col("quantity_p95") - F.col("quantity")), F.col("price") * (F.col("quantity") - F.col("quantity_p5"))
    return out.withColumn("cost", F.round(F.col("price") * F.col("quantity"), 2)).withColumn("var", F.round(F.greatest(F.lit(0.0), over), 2)).withColumn("cvar", F.round(1.2 * F.greatest(F.lit(0.0), over) + 0.5 * F.greatest(F.lit(0.0), under), 2)).withColumn("result_confidence", F.round(F.col("confidence") * stays, 6))


def choose_algorithm(weeks: Column, volatility: Column, inherited: Column, perishable: Column, cash_tight: Column) -> Column:
    """The first algorithm that fits; one whose preconditions fail gives way to open_loop."""
    return (
        F.when(cash_tight, "robust_satisficing").when(inherited, "cold_inherit").when((weeks >= 52) & (volatility <= 0.45), "affine_simple")
        .when(perishable | ((weeks >= 8) & (volatility <= 0.4)), F.when(weeks >= 8, "inv_buffer").otherwise("open_loop")).when(weeks >= 4, "safety_stock").otherwise("open_loop")
    )


def applicable(weeks: Column, volatility: Column, inherited: Column, funded: Column) -> Column:
    """The algorithms whose preconditions hold, by name."""
    held = (("affine_simple", (weeks >= 52) & (volatility <= 0.45)), ("cold_inherit", inherited), ("inv_buffer", weeks >= 8), ("open_loop", F.lit(True)), ("robust_satisficing", funded), ("safety_stock", weeks >= 4))
    return F.array_compact(F.array(*(F.when(when, name) for name, when in held)))


def enough_suppliers(restrictions: Column, available: Column) -> Column:
    """The suppliers that the restrictions ask for (1 without any), and whether there are as many."""
    asked = F.transform(F.filter(restrictions, lambda r: r["kind"] == "min_proveedores"), lambda r: r["value"].cast("int"))
    least = F.greatest(F.lit(1), F.coalesce(F.array_max(asked), F.lit(1)))
    return F.struct(least.alias("least"), (available >= least).alias("enough"))


def plan_confidence(p_loss: Column, notes: Column) -> Column:
    """O5."""
    return F.greatest(F.lit(0.05), F.greatest(F.lit(0.1), 1 - p_loss) - F.least(F.lit(0.3), 0.05 * notes))
