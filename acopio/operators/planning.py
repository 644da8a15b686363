"""Plans as whole: budget trimming, feedback folds, concentration, causal graphs, forecasts, simulation, text ranking."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..registry import query
from ..sources.readers import table
from ..sources.shared import tasks_for
from .weekly import weekly


def budget_cuts(plans: DataFrame, keys: list[str], budget: Column, cost: Callable[[Column], Column] = lambda q: F.round(q * F.col("price"), 2)) -> DataFrame:
    """O2: items (sku, quantity, price) of each plan with quantity and cost within its budget, and whether they are kept; cost: what a quantity costs.

    From the most costly item down, quantities are halved while the total is
    too high; if it still is, items are dropped from the top until it fits.
    Both loops depend on running totals only, so they are windows.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("cost"), "sku")
    every, upto = Window.partitionBy(*keys), w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    rows = plans.withColumn("cost", cost(F.col("quantity"))).withColumn("most", budget)
    rows = rows.withColumn("half", F.greatest(F.lit(1), F.floor(F.col("quantity") * 0.5)).cast("long")).withColumn("saves", F.when(F.col("half") < F.col("quantity"), F.col("cost") - cost(F.col("half"))).otherwise(F.col("cost") - F.col("cost")))
    over = F.sum("cost").over(every) - before("saves") > F.col("most")
    rows = rows.withColumn("cut", over & (F.col("saves") > 0)).withColumn("quantity", F.when(F.col("cut"), F.col("half")).otherwise(F.col("quantity"))).withColumn("left", F.when(F.col("cut"), F.col("cost") - F.col("saves")).otherwise(F.col("cost")))
    kept = F.sum("left").over(every) - before("left") <= F.col("most")
    return rows.withColumn("kept", kept).drop("half", "saves", "cut", "most", "cost").withColumnRenamed("left", "cost")


def trim_to_budget(plans: DataFrame, keys: list[str], budget: Column, cost: Callable[[Column], Column] = lambda q: F.round(q * F.col("price"), 2)) -> DataFrame:
    """O2: the items that budget_cuts() keeps."""
    return budget_cuts(plans, keys, budget, cost).where("kept").drop("kept")


@query("""WITH p AS (SELECT l_orderkey AS plan, l_partkey AS sku, sum(l_quantity)::BIGINT AS quantity, floor(max(l_extendedprice / l_quantity) * 100) / 100 AS price FROM lineitem GROUP BY 1, 2), c AS (SELECT *, round(quantity * price, 2) AS cost, greatest(1, floor(quantity * 0.5))::BIGINT AS half FROM p),
s AS (SELECT *, CASE WHEN half < quantity THEN cost - round(half * price, 2) ELSE 0 END AS saves FROM c), t AS (SELECT *, sum(cost) OVER (PARTITION BY plan) - coalesce(sum(saves) OVER (PARTITION BY plan ORDER BY cost DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 60000 AND saves > 0 AS cut FROM s),
u AS (SELECT *, CASE WHEN cut THEN cost - saves ELSE cost END AS new FROM t), v AS (SELECT *, sum(new) OVER (PARTITION BY plan) - coalesce(sum(new) OVER (PARTITION BY plan ORDER BY cost DESC, sku ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 60000 AS kept FROM u)
SELECT plan, sku, CASE WHEN cut THEN half ELSE quantity END AS quantity, round(new, 2) AS cost FROM v WHERE kept""")
def trimmed_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("sku")).agg(F.sum("l_quantity").cast("long").alias("quantity"), (F.floor(F.max(F.col("l_extendedprice") / F.col("l_quantity")) * 100) / 100).alias("price"))
    return trim_to_budget(p, ["plan"], F.lit(60000.0)).select("plan", "sku", "quantity", F.round("cost", 2).alias("cost"))


@query("""WITH s AS (SELECT l_orderkey AS plan, l_suppkey AS supplier, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(cost) OVER (PARTITION BY plan) AS total, row_number() OVER (PARTITION BY plan ORDER BY cost DESC, supplier) AS place FROM s)
SELECT plan, supplier, round(cost / total, 4) AS share, round(cost * 0.15, 4) AS impact, CASE WHEN cost * 0.15 < 20000 THEN 'MEDIA' ELSE 'ALTA' END AS severity FROM r WHERE place = 1 AND cost / total >= 0.4""")
def supplier_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans that depend on one supplier for 40% of their cost or more."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_suppkey").alias("supplier")).agg(F.sum("l_extendedprice").alias("cost"))
    top = s.groupBy("plan").agg(F.sum("cost").alias("total"), F.max(F.struct("cost", (-F.col("supplier")).alias("s"))).alias("top")).withColumn("share", F.col("top.cost") / F.col("total"))
    impact = F.col("top.cost") * 0.15
    return top.where("share >= 0.4").select("plan", (-F.col("top.s")).alias("supplier"), F.round("share", 4).alias("share"), F.round(impact, 4).alias("impact"), F.when(impact < 20000, "MEDIA").otherwise("ALTA").alias("severity"))


def profiles(signals: DataFrame) -> DataFrame:
    """O23, ST9: each operator's confidence and version after its signals (operator, at, id, action), in order.

    A step adds and clamps, and so do steps in a row: x -> min(high, max(low,
    x + add)).  The signals of a day become one such step, and an operator's
    days are then put together, so no list is longer than a day's signals or
    an operator's days.
    """
    delta = lambda a: F.when(a == "APROBAR", 0.03).when(a == "RECHAZAR", -0.06).when(a == "MODIFICAR", 0.02).otherwise(0.0)
    clamp = lambda x, low, high: F.least(high, F.greatest(low, x))
    start = F.struct(F.lit(0.0).alias("add"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    then = lambda s, add, low, high: F.struct((s["add"] + add).alias("add"), clamp(s["low"] + add, low, high).alias("low"), clamp(s["high"] + add, low, high).alias("high"))
    told = F.array_sort(F.collect_list(F.struct("at", "id", "action")))
    days = signals.groupBy("operator", F.to_date("at").alias("day")).agg(F.aggregate(told, start, lambda s, x: then(s, delta(x["action"]), F.lit(0.0), F.lit(1.0))).alias("step"), F.count(F.lit(1)).alias("n"))
    steps = F.array_sort(F.collect_list(F.struct("day", "step")))
    whole = F.aggregate(steps, start, lambda s, x: then(s, x["step"]["add"], x["step"]["low"], x["step"]["high"]))
    out = days.groupBy("operator").agg(whole.alias("s"), F.sum("n").alias("n"))
    return out.select("operator", F.round(clamp(F.lit(0.5) + F.col("s.add"), F.col("s.low"), F.col("s.high")), 6).alias("confidence"), (F.col("n") + 1).alias("version"))


@query("""WITH e AS (SELECT user_id AS operator, list(CASE WHEN event_type = 'purchase' THEN 0.03 WHEN event_type = 'click' THEN -0.06 WHEN event_type = 'view' THEN 0.02 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id) AS steps FROM events GROUP BY 1)
SELECT operator, round(list_reduce(list_prepend(0.5::DOUBLE, steps), lambda s, x: least(1.0, greatest(0.0, s + x))), 6)::DOUBLE AS confidence, len(steps) + 1 AS version FROM e""")
def operator_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O23, ST9, X34, K17."""
    action = F.when(F.col("event_type") == "purchase", "APROBAR").when(F.col("event_type") == "click", "RECHAZAR").when(F.col("event_type") == "view", "MODIFICAR").otherwise("otro")
    return profiles(table(spark, sf_dir, "events").select(F.col("user_id").alias("operator"), F.col("ts").alias("at"), F.col("event_id").alias("id"), action.alias("action")))


@query("""WITH i AS (SELECT l_orderkey AS plan, l_partkey AS sku, l_suppkey AS supplier, l_quantity AS q, l_extendedprice AS cost, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS tq, sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS tc FROM lineitem)
SELECT plan, 'evento:' || plan AS source, 'sku:' || sku AS target, 'AFECTA' AS kind, round(sum(q) / max(tq), 4) AS weight FROM i GROUP BY 1, 2, 3 UNION ALL SELECT plan, 'sku:' || sku, 'prov:' || supplier, 'PROVEIDO_POR', round(sum(cost) / max(tc), 4) FROM i GROUP BY 1, 2, 3""")
def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges event -> part by quantity and part -> supplier by cost, with one pass for the totals.

    A plan's lines are dealt to their task once; edges are added up there by numbers and named last.
    """
    lines = table(spark, sf_dir, "lineitem")
    totals = Window.partitionBy("plan")
    i = lines.select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("cost")).repartition(tasks_for(spark, lines.count()), "plan")
    i = i.withColumn("tq", F.sum("q").over(totals)).withColumn("tc", F.sum("cost").over(totals))
    ends = F.array(F.struct(F.lit(True).alias("event"), F.lit(None).cast("long").alias("to"), F.col("q").alias("x"), F.col("tq").alias("t")), F.struct(F.lit(False).alias("event"), F.col("supplier").alias("to"), F.col("cost").alias("x"), F.col("tc").alias("t")))
    e = i.select("plan", "sku", F.inline(ends)).groupBy("plan", "sku", "event", "to").agg(F.round(F.sum("x") / F.max("t"), 4).alias("weight"))
    sku, named = F.concat(F.lit("sku:"), "sku"), lambda a, b: F.when(F.col("event"), a).otherwise(b)
    return e.select("plan", named(F.concat(F.lit("evento:"), "plan"), sku).alias("source"), named(sku, F.concat(F.lit("prov:"), "to")).alias("target"), named(F.lit("AFECTA"), F.lit("PROVEIDO_POR")).alias("kind"), "weight")


def smoothed(y: np.ndarray, m: int, multiplicative: bool, rates: np.ndarray, steps: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared error, means ahead (steps) and residuals of each series in y (series x n), smoothed with its row of rates (level, trend, season, and the share of the first two cycles' trend that it starts with, 1 if left out); m is the season's length, 0 for none.

    The recursion goes over the points once for all series together.
    """
    count, n = y.shape
    alpha, beta, gamma = rates.T[:3]
    share = rates[:, 3] if rates.shape[1] > 3 else 1.0
    level = y[:, : m or 1].mean(1)
    trend = share * (y[:, m : 2 * m].mean(1) - y[:, :m].mean(1)) / m if m else np.zeros(count)
    index = (y[:, :m] / level[:, None] if multiplicative else y[:, :m] - level[:, None]) if m else np.zeros((count, 1))
    errors = np.empty((count, n))
    for t in range(n):
        s, base = index[:, t % (m or 1)].copy(), level + trend
        if m and multiplicative:
            e = y[:, t] - base * s
            level, trend = base + alpha * e / np.maximum(s, 1e-6), trend + alpha * beta * e / np.maximum(s, 1e-6)
            index[:, t % m] = s + gamma * (1 - alpha) * e / np.maximum(base, 1e-6)
        else:
            e = y[:, t] - (base + s)
            level, trend = base + alpha * e, trend + alpha * beta * e
            if m:
                index[:, t % m] = s + gamma * (1 - alpha) * e
        errors[:, t] = e
    ahead = level[:, None] + trend[:, None] * np.arange(1, steps + 1)
    if m and steps:
        season = index[:, (n + np.arange(steps)) % m]
        ahead = ahead * season if multiplicative else ahead + season
    return np.square(errors).sum(1), np.maximum(ahead, 0.0), errors


def fitted_rates(y: np.ndarray, m: int, multiplicative: bool, starts: int = 8, rounds: int = 20, cells: int = 1 << 20) -> np.ndarray:
    """the rates of each series (series x 4) with the least squared error that a search finds.

    A coarse grid gives each series its best starts; from each, rates move (one
    or several) by a step that halves when no move helps.  All series and all moves of
    a round go through the recursion together, in blocks of about cells
    numbers.  Without season its rate is 0 and the share 1, and under eight points
    the trend's rate is 0.
    """
    grid = np.array([(a, b, c, d) for a in (0.01, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0) for b in ((0.0, 0.02, 0.06, 0.15, 0.35, 0.65, 1.0) if y.shape[1] >= 8 else (0.0,)) for c in ((0.0, 0.1, 0.25, 0.5, 0.75, 1.0) if m else (0.0,)) for d in ((0.0, 0.5, 1.0) if m else (1.0,))])
    free = [k for k, on in enumerate((True, y.shape[1] >= 8, bool(m), bool(m))) if on]

    def error(rows: np.ndarray, rates: np.ndarray) -> np.ndarray:
        """Of each of rows with each of its rates (rows x tried x 4)."""
        tried = rates.shape[1]
        return np.concatenate([smoothed(np.repeat(part, tried, 0), m, multiplicative, r.reshape(-1, 4))[0].reshape(len(part), tried) for part, r in zip(*(np.array_split(x, 1 + rows.size * tried // cells) for x in (rows, rates)), strict=True) if len(part)])

    first = error(y, np.broadcast_to(grid, (len(y), *grid.shape)))
    starts = min(starts, len(grid))
    order = np.argsort(first, axis=1, kind="stable")[:, :starts]
    rates, best = grid[order].reshape(-1, 4), np.take_along_axis(first, order, 1).ravel()
    rows, step = np.repeat(y, starts, 0), np.full(len(best), 0.1)
    ways = np.array([w for w in product((-1, 0, 1), repeat=4) if any(w) and all(x == 0 for k, x in enumerate(w) if k not in free)])
    for _ in range(rounds):
        moves = rates[:, None] + step[:, None, None] * ways[None]
        moves = np.clip(moves, 0.0, 1.0)
        found = error(rows, moves)
        at = found.argmin(1)
        better = found[np.arange(len(at)), at] < best
        rates[better], best[better] = moves[better, at[better]], found[better, at[better]]
        step = np.where(better, step, step / 2)
    place = best.reshape(len(y), starts).argmin(1)
    return rates.reshape(len(y), starts, 4)[np.arange(len(y)), place]


def _smoothed(y: np.ndarray, steps: int, m: int, multiplicative: bool, rates: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Means ahead and residuals of each series in y (n, or series x n), with these rates or, without any, fitted ones."""
    rows = np.atleast_2d(y).astype(float)
    held = fitted_rates(rows, m, multiplicative) if rates is None else np.tile(np.array(rates), (len(rows), 1))
    _, means, residuals = smoothed(rows, m, multiplicative, held, steps)
    return (means, residuals) if np.ndim(y) == 2 else (means[0], residuals[0])


def holt_winters(y: np.ndarray, steps: int, season: int = 52, rates: tuple[float, float, float] | None = None) -> tuple[np.ndarray, float]:
    """level, trend (from eight points) and multiplicative season (from two cycles), with fitted rates; mean and residual spread.

    Under four points, and with a season but values that are not positive,
    the mean is the forecast.
    """
    mean, std = forecast_many([y], steps, season, rates)
    return mean[0], float(std[0])


def forecast_many(series: list[np.ndarray], steps: int, season: int = 52, rates: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """holt_winters() of many series; those of one length go together."""
    means, spread = np.zeros((len(series), steps)), np.ones(len(series))
    by_length: dict[int, list[int]] = {}
    for k, y in enumerate(series):
        by_length.setdefault(len(y), []).append(k)
    for n, at in by_length.items():
        if n == 0:
            continue
        where, y = np.array(at), np.stack([np.asarray(series[k], float) for k in at])
        m = season if n >= 2 * season else 0
        flat = np.full(len(at), n < 4) | ((y.min(1) <= 0) if m else False)
        if flat.any():
            means[where[flat]], spread[where[flat]] = y[flat].mean(1)[:, None], np.where(y[flat].std(1) == 0, 1.0, y[flat].std(1))
        if not flat.all():
            ahead, errors = _smoothed(y[~flat], steps, m, True, rates)
            std = errors.std(1)
            means[where[~flat]], spread[where[~flat]] = ahead, np.where(std == 0, np.maximum(1.0, 0.3 * y[~flat].mean(1)), std)
    return means, spread


def ets_samples(y: np.ndarray, steps: int, n_samples: int, seed: int, season: int = 52) -> np.ndarray:
    """the last step of an additive model (season from two cycles) plus residuals drawn with replacement."""
    mean, errors = _smoothed(y, steps, season if len(y) >= 2 * season else 0, False)
    if np.allclose(np.std(errors), 0):
        errors = np.array([0.0, 1.0, -1.0])
    return np.maximum(0, mean[-1] + np.random.default_rng(seed).choice(errors, n_samples))


def confidence(y: np.ndarray, source: str) -> float:
    """F8: length, steadiness, lag-52 autocorrelation and source of a series, weighted."""
    cv = cycle = 0.0
    if len(y) >= 8:
        cv = float(y.std() / y.mean()) if y.mean() > 0 else 0.0
        if len(y) > 53 and y[52:].std() > 0 and y[:-52].std() > 0:
            cycle = float(np.corrcoef(y[52:], y[:-52])[0, 1])
    kind = {"own": 1.0, "inherited": 0.7, "category_default": 0.4, "trend_only": 0.3}[source]
    return min(1.0, max(0.0, 0.3 * min(1.0, len(y) / 104) + 0.25 * max(0.0, 1 - cv) + 0.15 * (cycle + 1) / 2 + 0.3 * kind))


def sourced_series(parts: DataFrame, series: DataFrame, edges: DataFrame, donors: DataFrame | None = None, least: int = 12, low: float = 0.6, find: Callable[[DataFrame], DataFrame] | None = None, tasks: int | None = None) -> DataFrame:
    """The series each part (part, category) is forecast from: part, n_own, y, source, donor.

    Series are dealt by part to so many tasks, if given, and stay there until the category's weeks are added up.

    An explicit donor (part, donor) goes first, then the part's own series of
    least weeks or more, what find gives (part, donor; it gets the parts that
    have neither), the best edge (id, other, score) of low or more, the mean of
    the category's parts that sold in a week, and nothing.
    """
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("year", "week", x.alias("x")))), lambda r: r["x"])
    if tasks:
        parts, series = parts.repartition(tasks, "part"), series.repartition(tasks, "part")
    own = series.groupBy("part").agg(listed(F.col("units").cast("double")).alias("y"))
    mean = series.join(parts, "part").groupBy("category", "year", "week").agg((F.sum("units") / F.countDistinct("part")).alias("units"))
    category = mean.groupBy("category").agg(listed(F.col("units")).alias("y_category"))
    best = edges.groupBy(F.col("id").alias("part")).agg(F.max(F.struct("score", (-F.col("other")).alias("other"))).alias("best")).where(F.col("best.score") >= low).select("part", (-F.col("best.other")).alias("found"))
    none = F.array().cast("array<double>")
    rows = parts.join(own, "part", "left").join(best, "part", "left").withColumn("y", F.coalesce("y", none)).withColumn("n_own", F.size("y"))
    rows = rows.join(donors, "part", "left") if donors is not None else rows.withColumn("donor", F.lit(None).cast("long"))
    has_own = F.col("n_own") >= least
    if find is not None:
        own_finds = find(rows.where(F.col("donor").isNull() & ~has_own).select("part", "category", "n_own")).groupBy("part").agg(F.min("donor").alias("special"))
        rows = rows.join(own_finds, "part", "left").withColumn("found", F.coalesce("special", "found")).drop("special")
    donor = F.coalesce("donor", F.when(~has_own, F.col("found")))
    # Parts without a donor, most of them, are dealt by their own key: a null donor is one key.
    rows = rows.withColumn("donor", donor).withColumn("deal", F.when(donor.isNull(), F.col("part")))
    given = own.select(F.col("part").alias("from"), F.col("y").alias("y_donor"), F.lit(None).cast("long").alias("none"))
    rows = rows.join(given, (F.col("donor") == F.col("from")) & F.col("deal").eqNullSafe(F.col("none")), "left").drop("from", "none", "deal").join(category, "category", "left")
    source = F.when(F.col("donor").isNotNull(), "inherited").when(has_own, "own").when(F.col("y_category").isNotNull(), "category_default").otherwise("trend_only")
    chosen = F.when(F.col("donor").isNotNull(), F.coalesce("y_donor", none)).when(has_own, F.col("y")).otherwise(F.coalesce("y_category", none))
    return rows.select("part", "n_own", chosen.alias("y"), source.alias("source"), "donor")


@query()
def demand_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight weeks ahead of each part of the catalogue, with the band of seeded samples.  Rows only."""
    from .neighbours import nearest

    def forecast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            series = [np.asarray(y, float) for y in pdf["y"]]
            means, spread = forecast_many(series, 8)
            out = []
            for r, y, mean, std in zip(pdf.itertuples(index=False), series, means, spread, strict=True):
                draws = np.maximum(0, np.random.default_rng(r.part).normal(mean, std, (1000, 8)))
                low, middle, high = np.percentile(draws, [5, 50, 95], axis=0)
                out.append((r.part, mean, low, middle, high, r.source, None if pd.isna(r.donor) else int(r.donor), r.n_own, confidence(y, r.source)))
            if out:
                part, mean, low, middle, high, source, donor, n_own, sure = zip(*out, strict=True)
                rows = {"part": np.repeat(part, 8), "step": np.tile(np.arange(1, 9), len(part)), "mean": np.concatenate(mean), "p05": np.concatenate(low), "p50": np.concatenate(middle), "p95": np.concatenate(high)}
                rows |= {"source": np.repeat(source, 8), "donor": pd.array([d for d in donor for _ in range(8)], "Int64"), "n_own": np.repeat(n_own, 8), "confidence": np.repeat(sure, 8)}
                yield pd.DataFrame(rows)

    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category"))
    series, vectors = weekly(spark, sf_dir), table(spark, sf_dir, "embeddings")
    # Only parts of under 12 weeks look for a donor.
    long = series.groupBy(F.col("part").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    edges = nearest(vectors, "vec_id", "embedding", "label", k=1, wanted=vectors.join(long, "vec_id", "left_anti"))
    # The forecasts are the work, not the rows: as many tasks as shuffle partitions, which adaptive execution leaves alone.
    dealt = sourced_series(parts, series, edges, tasks=tasks_for(spark, table(spark, sf_dir, "lineitem").count())).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.mapInPandas(forecast, "part long, step int, mean double, p05 double, p50 double, p95 double, source string, donor long, n_own int, confidence double")


class Restriction(NamedTuple):
    """A norm on plans: its kind, its ID and its parameter (units, money; unused for shelf life)."""

    kind: str
    norm: str
    limit: float | None = None


#: From so many standard deviations of a week on, no week's demand is clipped (a chance of 3 in 10 million).
CLEAR = 5.0
#: Items of a plan that one task simulates at once.
CHUNK = 4096
#: Normal numbers that a process keeps for the plans that follow (16 bytes each).
HELD = 12_000_000
#: Items whose demand is added up at once.
BLOCK = 16


class _Outcome(NamedTuple):
    """Sums over items for each simulation, and what the whole plan costs."""

    profit: np.ndarray
    revenue: np.ndarray
    valid: np.ndarray
    violations: dict[str, int]
    total: float


@lru_cache(maxsize=4096)
def _clipped_sum(n: int, step: int) -> np.ndarray:
    """The sum of n normal numbers of spread 1 and mean step / 32, each clipped at 0, as a function of a normal number, at 1025 points from -5.5 to 5.5.

    The sum's distribution is the n-fold convolution of one week's, on a grid
    of 8,192 cells.
    """
    mean, cells = step / 32, 8192
    width = n * (mean + 7) / cells
    below = lambda x: np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x])
    edges = (np.arange(cells) + 0.5) * width
    week = np.diff(below(edges - mean), prepend=0.0)
    total = np.maximum.accumulate(np.cumsum(np.fft.irfft(np.fft.rfft(week) ** n, cells)))
    return np.interp(below(np.linspace(-5.5, 5.5, 1025)), total, edges, left=0.0)


class _Draws:
    """Standard normal numbers, one for each simulation, and where they lie in the tables of _clipped_sum()."""

    def __init__(self, rng: np.random.Generator, n_sims: int):
        self.z = rng.standard_normal(n_sims, np.float32)
        self.top = float(self.z.max(initial=-math.inf))

    @cached_property
    def place(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip((self.z + np.float32(5.5)) * np.float32(1024 / 11), 0, np.float32(1023.99))
        cell = at.astype(np.intp)
        return cell, at - cell.astype(np.float32)


def _excess(x: NamedTuple, n: int, draws: _Draws, rng: np.random.Generator | None, out: np.ndarray) -> None:
    """What the demand of n of an item's weeks exceeds n means by: a sum of normal weeks, each clipped at 0.

    Weeks that are never clipped add up to a normal number; else a normal
    number is bent to the distribution of the sum (interpolated, off by less
    than a hundredth of a week's spread).  Means below 0 are drawn week by week.
    """
    weeks = int(x.weeks)
    unit, mean = x.std / math.sqrt(weeks), x.mean / weeks
    if not mean >= 0:
        out[:] = np.maximum(0, rng.standard_normal((n, len(out))) * unit + mean).sum(0) - mean * n
    elif mean >= CLEAR * unit:
        np.multiply(draws.z, np.float32(unit * math.sqrt(n)), out=out)
    else:
        step, part = divmod(mean / unit * 32, 1)
        bent = unit * ((1 - part) * _clipped_sum(n, int(step)) + part * _clipped_sum(n, int(step) + 1)) - mean * n
        cell, rest = draws.place
        np.take(np.diff(bent).astype(np.float32), cell, out=out, mode="clip")
        out *= rest
        out += bent.astype(np.float32)[cell]


def _weekly_demand(rng: np.random.Generator, x: NamedTuple, n_sims: int, within: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Demand of all weeks and, if within is not 0, of the first so many."""
    total = np.zeros(n_sims)
    upto = []
    for n in filter(None, (within, int(x.weeks) - within)):
        part = np.empty(n_sims, np.float32)
        _excess(x, n, _Draws(rng, n_sims), rng, part)
        total = total + part + x.mean / int(x.weeks) * n
        upto.append(total)
    return total, upto[0] if within else None


def _keyed(seed: int, key: str) -> np.random.Generator:
    """A generator (of SFC64 bits) at the start of a key's own draws."""
    words = np.frombuffer(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=24).digest(), np.uint64)
    generator = np.random.Generator(np.random.SFC64(0))
    generator.bit_generator.state = {"bit_generator": "SFC64", "state": {"state": np.append(words, np.uint64(1))}, "has_uint32": 0, "uinteger": 0}
    generator.bit_generator.random_raw(18, output=False)
    return generator


_drawn: dict[tuple[int, int, int, int], _Draws] = {}


def _draws(seed: int, n_sims: int, place: int, part: int) -> _Draws:
    """The draws of a place in a plan, of its early (0) or late (1) weeks; a process keeps HELD numbers of them."""
    key = (seed, n_sims, place, part)
    if key in _drawn:
        return _drawn[key]
    out = _Draws(_keyed(seed, f"{place}:{part}"), n_sims)
    if (len(_drawn) + 1) * n_sims <= HELD:
        _drawn[key] = out
    return out


def _simulated(items: pd.DataFrame, n_sims: int, seed: int, restrictions: tuple[Restriction, ...]) -> _Outcome:
    """Profit, revenue and validity of each simulation of a plan's items, and violations by norm; the budget is not looked at.

    Each item has draws of its own within its plan, those of its place there,
    and is added in the order of places, so that results depend on neither
    partitions nor the order of rows.
    """
    profit, revenue, valid, certain, taken = np.zeros(n_sims), np.zeros(n_sims), np.ones(n_sims, bool), [], []
    violations: dict[str, int] = {}
    if _drawn and next(iter(_drawn))[:2] != (seed, n_sims):
        _drawn.clear()

    def mark(norm: str, n_ok: int, ok: np.ndarray | bool) -> None:
        if n_ok < n_sims:
            violations[norm] = violations.get(norm, 0) + n_sims - n_ok
            valid[:] &= ok

    shelf = [r.norm for r in restrictions if r.kind == "no_exceder_dias_validez"]
    # Rows of BLOCK items: what demand exceeds its mean by; of that what is sold; what a unit of either is worth.
    over, late = np.empty((BLOCK, n_sims), np.float32), np.empty(n_sims, np.float32)
    room, (gain, price, missed) = np.empty((BLOCK, 1), np.float32), np.empty((3, BLOCK), np.float32)
    items = items.sort_values("place", kind="stable")
    for at, x in enumerate(items.itertuples(index=False)):
        for r in restrictions:
            if r.kind == "cantidad_minima_proveedor":
                least = r.limit if r.limit is not None else getattr(x, "min_order", None)
                if least is not None and not pd.isna(least):
                    mark(r.norm, n_sims if x.quantity >= int(least) else 0, False)
        within = max(1, int(x.shelf_days) // 7) if shelf and x.perishable and not pd.isna(x.shelf_days) else 0
        weeks, within = int(x.weeks), within if within < x.weeks else 0
        k, draws, rng = at % BLOCK, _draws(seed, n_sims, x.place, 0), None if x.mean >= 0 else _keyed(seed, f"{x.place}:2")
        _excess(x, within or weeks, draws, rng, over[k])
        if within:
            least = x.quantity - x.mean / weeks * within
            never = x.mean / weeks >= CLEAR * x.std / math.sqrt(weeks) and draws.top * x.std * math.sqrt(within / weeks) < least
            ok = False if never else over[k] >= least
            for norm in shelf:
                mark(norm, 0 if never else int(np.count_nonzero(ok)), ok)
            _excess(x, weeks - within, _draws(seed, n_sims, x.place, 1), rng, late)
            over[k] += late
        # What is left over loses its cost or a share of it, what is missed its margin.
        lost, margin = x.cost * (1.0 if x.perishable else 0.7), max(0.0, x.price - x.cost)
        room[k], gain[k], price[k], missed[k] = x.quantity - x.mean, x.price + lost + margin, x.price, margin
        certain += [x.mean * (x.price + lost), -x.quantity * (x.cost + lost)]
        taken.append(x.mean * x.price)
        if k + 1 == BLOCK or at + 1 == len(items):
            held = over[: k + 1]
            profit -= missed[: k + 1] @ held
            np.minimum(held, room[: k + 1], out=held)
            profit += gain[: k + 1] @ held
            revenue += price[: k + 1] @ held
    return _Outcome(profit + math.fsum(certain), revenue + math.fsum(taken), valid, violations, math.fsum(items["quantity"] * items["cost"]))


def _by_plan(items: DataFrame, n_sims: int, seed: int, restrictions: tuple[Restriction, ...], finish: Callable[[pa.Scalar, _Outcome], pa.Table], schema: str, chunk: int = CHUNK) -> DataFrame:
    """finish(plan, outcome) of each plan.

    Plans of over chunk items are dealt to several tasks, whose sums are added
    afterwards, in the order of the chunks.  An item's draws are those of its
    place in its plan, in the order of sku: within a plan all are independent,
    while the n-th items of any two plans share theirs (common random numbers),
    which a task then draws once and not for each plan.
    """
    plan = items.schema["plan"].dataType.simpleString()
    dealt = items.withColumn("place", F.dense_rank().over(Window.partitionBy("plan").orderBy("sku"))).withColumn("_chunk", F.floor((F.col("place") - 1) / chunk).cast("int"))
    # The draws are the work, not the rows: as many tasks as shuffle partitions, which adaptive execution leaves alone.
    dealt = dealt.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "plan", "_chunk")
    sums = {"_chunk": pa.int32(), "_profit": pa.binary(), "_revenue": pa.binary(), "_valid": pa.binary(), "_violations": pa.map_(pa.string(), pa.int64()), "_total": pa.float64()}

    def closed(key: pa.Scalar, o: _Outcome) -> pa.Table:
        for r in restrictions:
            if r.kind == "presupuesto_maximo_pyg" and r.limit is not None and o.total > r.limit:
                o.violations[r.norm] = o.violations.get(r.norm, 0) + n_sims
                o.valid[:] = False
        return finish(key, o)

    def part(rows: pa.Table) -> pa.Table:
        key, place = rows["plan"][0], rows["_chunk"][0].as_py()
        o = _simulated(rows.drop_columns(["_chunk"]).to_pandas(), n_sims, seed, restrictions)
        if pc.max(rows["place"]).as_py() < chunk:
            done = closed(key, o)
            return pa.table({c: done[c] for c in done.column_names} | {c: pa.nulls(len(done), kind) for c, kind in sums.items()})
        told = (place, o.profit.tobytes(), o.revenue.tobytes(), o.valid.tobytes(), list(o.violations.items()), o.total)
        return pa.table({f.name: rows["plan"].slice(0, 1) if f.name == "plan" else pa.nulls(1, f.type) for f in fields} | {c: pa.array([v], kind) for (c, kind), v in zip(sums.items(), told, strict=True)})

    def whole(rows: pa.Table) -> pa.Table:
        if not rows["_profit"][0].is_valid:
            return rows.select([f.name for f in fields])
        profit, revenue, valid, violations, totals = np.zeros(n_sims), np.zeros(n_sims), np.ones(n_sims, bool), {}, []
        for r in rows.sort_by("_chunk").select(list(sums)).to_pylist():
            profit += np.frombuffer(r["_profit"])
            revenue += np.frombuffer(r["_revenue"])
            valid &= np.frombuffer(r["_valid"], bool)
            for norm, n in r["_violations"]:
                violations[norm] = violations.get(norm, 0) + n
            totals.append(r["_total"])
        return closed(rows["plan"][0], _Outcome(profit, revenue, valid, violations, math.fsum(totals)))

    declared = f"plan {plan}, {schema}"
    fields = to_arrow_schema(StructType.fromDDL(declared))
    partly = dealt.groupBy("plan", "_chunk").applyInArrow(part, declared + ", _chunk int, _profit binary, _revenue binary, _valid binary, _violations map<string,bigint>, _total double")
    return partly.groupBy("plan").applyInArrow(whole, declared)


def simulate(items: DataFrame, n_sims: int, seed: int, restrictions: tuple[Restriction, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Profit, revenue and validity of each simulation of a plan.

    items: plan, sku, quantity, mean, std (both of all weeks), price, cost,
    shelf_days, weeks, perishable, min_order (if any).  Weekly demand is
    normal and clipped; what perishes unsold is lost whole, else at 70%;
    missed sales cost their margin.  A simulation is valid if no item and not
    the plan violates a restriction; unknown kinds are ignored.
    """

    def rows(plan: pa.Scalar, o: _Outcome) -> pa.Table:
        return pa.table({"plan": pa.repeat(plan, n_sims), "sim": pa.array(np.arange(n_sims, dtype=np.int32)), "profit": o.profit, "revenue": o.revenue, "valid": o.valid})

    return _by_plan(items, n_sims, seed, restrictions, rows, "sim int, profit double, revenue double, valid boolean", chunk)


def risk_panel(items: DataFrame, n_sims: int, seed: int, restrictions: tuple[Restriction, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """M1, M6: a row for each plan, without its simulations as rows.

    The figures of profit are over all simulations (M6).  Those of revenue
    are over the valid ones, null without any (M1), with the number of valid
    ones and of violations by norm.
    """
    names = ("mean", "std", "p05", "p95", "var", "cvar", "sharpe", "p_loss")
    taken = ("revenue_mean", "revenue_p05", "revenue_p50", "revenue_p95")
    schema = ", ".join(f"{c} double" for c in names) + ", n_sims int, n_valid int, total_cost double, " + ", ".join(f"{c} double" for c in taken) + ", violations map<string,bigint>"

    def panel(plan: pa.Scalar, o: _Outcome) -> pa.Table:
        profit, won = o.profit, o.revenue[o.valid]
        cut, high = np.percentile(profit, [5, 95])
        mean, std, tail = profit.mean(), profit.std(), profit[profit <= cut].mean()
        risk = (mean, std, cut, high, max(0.0, -cut), max(0.0, -tail), mean / std if std > 1e-9 else None, (profit < 0).mean())
        gained = (won.mean(), *np.percentile(won, [5, 50, 95])) if len(won) else (None,) * 4
        number = lambda x: pa.array([None if x is None else round(float(x), 4)], pa.float64())
        columns = {"plan": pa.repeat(plan, 1)} | {c: number(x) for c, x in zip(names, risk, strict=True)} | {"n_sims": pa.array([n_sims], pa.int32()), "n_valid": pa.array([int(o.valid.sum())], pa.int32()), "total_cost": number(o.total)}
        return pa.table(columns | {c: number(x) for c, x in zip(taken, gained, strict=True)} | {"violations": pa.array([list(o.violations.items())], pa.map_(pa.string(), pa.int64()))})

    return _by_plan(items, n_sims, seed, restrictions, panel, schema, chunk)


#: Of plan_risk: shelf life, an order minimum of one unit, a budget.
PLAN_NORMS = (Restriction("no_exceder_dias_validez", "N-001"), Restriction("cantidad_minima_proveedor", "N-002", 1), Restriction("presupuesto_maximo_pyg", "N-003", 10_000_000.0))


@query()
def plan_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk panel of 10,000 simulations of each supplier's assortment.  Rows only."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), (F.col("p_type") == "PROMO").alias("perishable"), F.col("p_size").alias("shelf_days"))
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("plan"), F.col("l_partkey").alias("sku")).agg(F.sum("l_quantity").alias("quantity"), (F.avg("l_quantity") * F.count(F.lit(1))).alias("mean"), (F.stddev_pop("l_quantity") + 1).alias("std"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    i = i.withColumn("cost", F.col("price") * 0.65).withColumn("weeks", F.lit(8)).join(part, "sku")
    return risk_panel(i, 10_000, 42, PLAN_NORMS)
