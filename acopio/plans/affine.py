"""Robust affine ordering as columns: sensitivities, worst-case load, inputs and items."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA, GAIN, PERIODS = 0.15, 1.0, 8


def error_weights(periods: int, alpha: float = ALPHA, gain: float = GAIN) -> np.ndarray:
    """Row t holds the weights of the errors before t, gain * exp(-alpha * (t - u - 1))."""
    lag = np.subtract.outer(np.arange(periods), np.arange(periods)) - 1.0
    return np.where(lag >= 0, gain * np.exp(-alpha * np.maximum(lag, 0)), 0.0)


def sensitivity(u: Column, service: Column, lead_weeks: Column, at: int, alpha: float = ALPHA, gain: float = GAIN) -> Column:
    """What an error of period u does to the order at period at: a geometric sum of decays less the service rate."""
    left = F.greatest(F.lit(0.0), F.lit(float(at)) - lead_weeks - u)
    decay = float(np.exp(-alpha))
    return gain * (left if np.isclose(decay, 1.0) else (1 - F.power(F.lit(decay), left)) / (1 - decay)) - service


def robust_load(service: Column, lead_weeks: Column, epsilon: Column, sigma: Column, periods: int = PERIODS, at: int | None = None, alpha: float = ALPHA, gain: float = GAIN) -> Column:
    """Deviations that count in the worst case, summed over the periods."""
    at = periods if at is None else at
    over = lambda u: epsilon * F.greatest(F.lit(0.0), F.abs(sensitivity(u.cast("double"), service, lead_weeks, at, alpha, gain)) - gain**2 / F.greatest(sigma, F.lit(1e-9)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(periods - 1)), F.lit(0.0), lambda s, u: s + over(u))


def viable(relations: DataFrame, excluded: list[str] | None = None, days_to_event: int | None = None, buffer_days: int = 5) -> DataFrame:
    """Active relations of suppliers that are not excluded and deliver, with a buffer, before the event."""
    out = relations.where(F.col("active"))
    out = out.where(~F.col("supplier").cast("string").isin(excluded)) if excluded else out
    return out if days_to_event is None else out.where(F.coalesce(F.col("lead_max") + buffer_days <= days_to_event, F.lit(True)))


def inputs(relations: DataFrame, periods: int = PERIODS) -> DataFrame:
    """One row for each (part, supplier): demand, capacity, rates and the worst-case load.

    relations: p50, std, moq, reliability, lead_min, lead_max.  What the
    policy needs stays a table; no matrix is collected.
    """
    demand = F.greatest(F.lit(1.0), F.col("p50"))
    out = relations.withColumns({
        "demand": demand, "lead_weeks": (F.col("lead_min") + F.col("lead_max")) / 2 / 7, "capacity": F.greatest(F.col("moq") * 20.0, demand * 3),
        "service": F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("reliability"))), "epsilon": F.greatest(F.lit(1.0), F.col("std") * 0.5), "sigma": F.greatest(F.lit(1.0), F.col("std")),
    })
    return out.withColumn("load", robust_load(F.col("service"), F.col("lead_weeks"), F.col("epsilon"), F.col("sigma"), periods))


def items(solution: DataFrame, today: Column, event: Column) -> DataFrame:
    """Quantities (w is the supplier's place in its plan) as dated items; those that round to 0 go."""
    arrival = F.date_add(today, (14 + 7 * F.col("w")).cast("int"))
    out = solution.withColumn("quantity", F.bround(F.greatest(F.lit(0.0), F.col("x"))).cast("long")).where("quantity > 0")
    return out.withColumns({"cost": F.round(F.col("quantity") * F.col("price"), 2), "arrival": arrival, "buffer_weeks": F.round(F.greatest(F.lit(0.0), F.datediff(event, arrival) / 7.0), 2)})


def solve(plans: DataFrame, key: str, schema: str, solver: Callable[[pd.DataFrame], pd.DataFrame] | None, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each plan by a solver that is supplied, else by the heuristic plan; the engine's own way is plans/robust.py."""
    return fallback(plans) if solver is None else plans.groupBy(key).applyInPandas(solver, schema)
