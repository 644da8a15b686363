"""Weekly series of parts: sales by ISO week, velocity, features, smoothing, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.readers import table
from ..sources.shared import tasks_for

_WEEKLY = "SELECT l_partkey AS part, isoyear(l_shipdate) AS year, week(l_shipdate) AS week, sum(l_quantity) AS units, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1, 2, 3"
CUT = "1998-08-01"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and amount of each part and ISO week.

    Most lines have a week of their own, so they are dealt first: adding up
    what a file split holds would take memory and save no shuffle.
    """
    week = (F.extract(F.lit("YEAROFWEEK"), "l_shipdate").cast("long").alias("year"), F.weekofyear("l_shipdate").cast("long").alias("week"))
    lines = table(spark, sf_dir, "lineitem")
    dealt = lines.select(F.col("l_partkey").alias("part"), *week, "l_quantity", "l_extendedprice").repartition(tasks_for(spark, lines.count()), "part", "year", "week")
    return dealt.groupBy("part", "year", "week").agg(F.sum("l_quantity").alias("units"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))


def recent_weeks(spark: SparkSession, cut: str = CUT, n: int = 12) -> DataFrame:
    """The n ISO weeks up to a date."""
    days = F.explode(F.sequence(F.date_sub(F.to_date(F.lit(cut)), 7 * (n - 1)), F.to_date(F.lit(cut)), F.expr("interval 7 days"))).alias("d")
    return spark.range(1).select(days).select(F.extract(F.lit("YEAROFWEEK"), "d").cast("long").alias("year"), F.weekofyear("d").cast("long").alias("week"))


@query(_WEEKLY)
def weekly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6, F3, S4, X5."""
    return weekly(spark, sf_dir)


_VELOCITY = f"""w AS ({_WEEKLY}), r AS (SELECT DISTINCT isoyear(d) AS year, week(d) AS week FROM (SELECT DATE '{CUT}' - 7 * k::INT AS d FROM range(12) x(k))),
v AS (SELECT p_partkey AS part, coalesce(round(avg(units), 6), 0.0) AS velocity FROM part LEFT JOIN (SELECT part, units FROM w JOIN r USING (year, week)) ON part = p_partkey GROUP BY 1)"""


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean units of the weeks with sales among the last twelve; 0 without any."""
    sold = weekly(spark, sf_dir).join(F.broadcast(recent_weeks(spark)), ["year", "week"]).groupBy("part").agg(F.round(F.avg("units"), 6).alias("velocity"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(sold, "part", "left").select("part", F.coalesce("velocity", F.lit(0.0)).alias("velocity"))


@query(f"WITH {_VELOCITY} SELECT * FROM v")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocities(spark, sf_dir)


@query(f"""WITH {_VELOCITY}, p AS (SELECT velocity, row_number() OVER (ORDER BY velocity) AS rn, count(*) OVER () AS n FROM v WHERE velocity > 0)
SELECT part, velocity, velocity > 0 AND velocity >= (SELECT max(velocity) FROM p WHERE rn = floor(0.75 * (n - 1)) + 1) AS high_rotation FROM v""")
def high_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At or over the 75th percentile by lower nearest rank of the positive velocities.

    Velocities are counted in bins of a thousandth of their logarithm, of
    which there are some ten thousand whatever the number of parts; only the
    bin that holds the rank is then ranked by value.
    """
    v = velocities(spark, sf_dir)
    counts = v.where("velocity > 0").groupBy(F.floor(F.log1p("velocity") * 1000).alias("bin"), "velocity").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.groupBy("bin").agg(F.sum("n").alias("n"))
    run = bins.select("bin", "n", F.sum("n").over(Window.orderBy("bin")).alias("to"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("all"))
    held = run.where("to >= floor(0.75 * (all - 1)) + 1").agg(F.min_by(F.struct("bin", (F.floor(0.75 * (F.col("all") - 1)) + 1 - (F.col("to") - F.col("n"))).alias("rank")), "bin").alias("b")).select("b.*")
    inside = counts.select("bin", "velocity", "n").join(F.broadcast(held), "bin").withColumn("to", F.sum("n").over(Window.partitionBy("bin").orderBy("velocity")))
    p75 = inside.where("to >= rank").agg(F.min("velocity").alias("p75"))
    return v.join(F.broadcast(p75), how="cross").select("part", "velocity", ((F.col("velocity") > 0) & (F.col("velocity") >= F.col("p75"))).alias("high_rotation"))


@query(f"""WITH w AS ({_WEEKLY}) SELECT p_partkey AS part, count(week) AS n_weeks, count(week) >= 12 AS has_history, coalesce(sum(units), 0) AS units,
CASE WHEN count(week) >= 52 AND sum(units) >= 500 THEN 'A' WHEN count(week) >= 40 THEN 'B' WHEN count(week) >= 12 THEN 'C' WHEN count(week) >= 1 THEN 'D' ELSE 'E' END AS tier
FROM part LEFT JOIN w ON part = p_partkey GROUP BY 1""")
def history_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough history, and the tier."""
    n, units = F.count("week"), F.coalesce(F.sum("units"), F.lit(0.0))
    tier = F.when((n >= 52) & (units >= 500), "A").when(n >= 40, "B").when(n >= 12, "C").when(n >= 1, "D").otherwise("E")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")).join(weekly(spark, sf_dir), "part", "left").groupBy("part").agg(n.alias("n_weeks"), (n >= 12).alias("has_history"), units.alias("units"), tier.alias("tier"))


@query(f"""WITH w AS ({_WEEKLY}) SELECT p_type AS category, year, week, round(sum(units) / count(DISTINCT part), 6) AS mean_units FROM w JOIN part ON p_partkey = part GROUP BY 1, 2, 3""")
def category_weekly_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a category and week over its parts that sold."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category"))
    return weekly(spark, sf_dir).join(part, "part").groupBy("category", "year", "week").agg(F.round(F.sum("units") / F.count(F.lit(1)), 6).alias("mean_units"))


@query(f"""WITH w AS ({_WEEKLY}), o AS (SELECT *, row_number() OVER a AS k, lag(units) OVER a AS prev, count(*) OVER (PARTITION BY part) AS n FROM w WINDOW a AS (PARTITION BY part ORDER BY year, week))
SELECT part, max(n) AS n_weeks, CASE WHEN max(n) < 8 THEN 0.0 ELSE round(coalesce(stddev_pop(units) / avg(units), 0), 4) + 0 END AS cv,
CASE WHEN max(n) < 8 THEN 0.0 ELSE round(CASE WHEN isnan(coalesce(corr(units, prev), 0)) THEN 0 ELSE coalesce(corr(units, prev), 0) END, 4) + 0 END AS lag1, CASE WHEN max(n) < 8 THEN 0.0 ELSE round(coalesce(regr_slope(units, k) FILTER (k > n - 12), 0), 4) + 0 END AS slope FROM o GROUP BY part""")
def series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation, lag-1 autocorrelation (by place), slope of the last twelve; 0 under eight weeks."""
    w = Window.partitionBy("part").orderBy("year", "week")
    rows = weekly(spark, sf_dir).select("part", "units", F.row_number().over(w).alias("k"), F.lag("units").over(w).alias("prev"), F.count(F.lit(1)).over(Window.partitionBy("part")).alias("n"))
    last = F.col("k") > F.col("n") - 12
    held = lambda c: F.when(F.max("n") < 8, 0.0).otherwise(F.round(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), 4) + F.lit(0.0))
    return rows.groupBy("part").agg(F.max("n").alias("n_weeks"), held(F.stddev_pop("units") / F.avg("units")).alias("cv"), held(F.corr("units", "prev")).alias("lag1"), held(F.regr_slope(F.when(last, F.col("units")), F.when(last, F.col("k")))).alias("slope"))


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """s = alpha v + (1 - alpha) s, from the first value on."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0), lambda s, v: alpha * v + (1 - alpha) * s)


@query(f"""WITH RECURSIVE w AS ({_WEEKLY}), o AS (SELECT part, units, row_number() OVER (PARTITION BY part ORDER BY year, week) AS k FROM w),
s(part, k, v) AS (SELECT part, k, units::DOUBLE FROM o WHERE k = 1 UNION ALL SELECT o.part, o.k, 0.3 * o.units + 0.7 * s.v FROM s JOIN o ON o.part = s.part AND o.k = s.k + 1)
SELECT part, round(max_by(v, k), 4) AS smoothed FROM s GROUP BY 1""")
def smoothed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted level of each part's series (a series has at most its weeks)."""
    series = F.transform(F.array_sort(F.collect_list(F.struct("year", "week", "units"))), lambda x: x["units"])
    return weekly(spark, sf_dir).groupBy("part").agg(series.alias("y")).select("part", F.round(ewma(F.col("y")), 4).alias("smoothed"))


@query(f"""WITH w AS ({_WEEKLY}), c AS (SELECT category, year, week, units FROM (SELECT DISTINCT p_type AS category FROM part) CROSS JOIN (SELECT DISTINCT year FROM w) CROSS JOIN (SELECT range + 1 AS week FROM range(53)) LEFT JOIN (SELECT p_type AS category, year, week, sum(units) AS units FROM w JOIN part ON p_partkey = part GROUP BY 1, 2, 3) USING (category, year, week))
SELECT category, year, week, coalesce(last_value(units IGNORE NULLS) OVER (PARTITION BY category ORDER BY year, week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(units IGNORE NULLS) OVER (PARTITION BY category ORDER BY year, week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS units FROM c""")
def filled_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weeks of all years filled forward, then backward, then 0; a category has as many rows as there are weeks."""
    part, sold = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category")), weekly(spark, sf_dir)
    sums = sold.join(part, "part").groupBy("category", "year", "week").agg(F.sum("units").alias("units"))
    years = sold.select("year").distinct().agg(F.collect_list("year").alias("years"))
    grid = part.select("category").distinct().join(F.broadcast(years), how="cross").select("category", F.explode("years").alias("year")).select("category", "year", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(53).cast("long"))).alias("week"))
    w = Window.partitionBy("category").orderBy("year", "week")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return grid.join(sums, ["category", "year", "week"], "left").select("category", "year", "week", F.coalesce(F.last("units", True).over(back), F.first("units", True).over(ahead), F.lit(0.0)).alias("units"))


@query(f"""WITH w AS ({_WEEKLY}), o AS (SELECT part, avg(units) AS own FROM w GROUP BY 1), c AS (SELECT p_type, avg(units) AS cat, stddev_pop(units) AS sd FROM w JOIN part ON p_partkey = part GROUP BY 1)
SELECT p_partkey AS part, round(CASE WHEN own IS NULL AND cat IS NULL THEN 5.0 ELSE greatest(1.0, coalesce(own, cat)) END, 4) AS level, round(greatest(1.0, 1.5 * coalesce(sd, 2.0)), 4) AS spread FROM part LEFT JOIN o ON o.part = p_partkey LEFT JOIN c USING (p_type)""")
def cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own mean, else the category's, else 5; spread with its penalty."""
    part, w = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_type"), weekly(spark, sf_dir)
    own = w.groupBy("part").agg(F.avg("units").alias("own"))
    cat = w.join(part, "part").groupBy("p_type").agg(F.avg("units").alias("cat"), F.stddev_pop("units").alias("sd"))
    level = F.when(F.col("own").isNull() & F.col("cat").isNull(), 5.0).otherwise(F.greatest(F.lit(1.0), F.coalesce("own", "cat")))
    return part.join(own, "part", "left").join(cat, "p_type", "left").select("part", F.round(level, 4).alias("level"), F.round(F.greatest(F.lit(1.0), 1.5 * F.coalesce("sd", F.lit(2.0))), 4).alias("spread"))


def profit_risk(df: DataFrame, keys: list[str], profit: str, alpha: float = 0.95) -> DataFrame:
    """Mean, spread, percentiles, VaR, CVaR, Sharpe and probability of loss of each group's samples.

    The samples of a group are sorted once, in a window that spills; the
    percentiles are the values at their ranks, and the tail is summed in the
    same pass, so the input is read once and no map of values is held.
    """
    x, every = F.col(profit), Window.partitionBy(*keys)
    rows = df.withColumn("__rn", F.row_number().over(every.orderBy(profit))).withColumn("__n", F.count(profit).over(every)).where(x.isNotNull())

    def value(q: float) -> tuple:
        """The place before the percentile, how far it is from there, and its two neighbours' values."""
        at = (F.col("__n") - 1) * F.round(F.lit(q), 9)
        low = F.floor(at).cast("long") + 1
        part = lambda k: F.max(F.when(F.col("__rn") == low + k, x)).over(every)
        return part(0) + (at - F.floor(at)) * (F.coalesce(part(1), part(0)) - part(0))

    rows = rows.withColumn("__cut", value(1 - alpha)).withColumn("__p95", value(0.95))
    # Decimals: neither the order of the rows nor a tie at the fifth digit decides how a mean is rounded.
    mean = lambda c: (F.sum(c.cast("decimal(28,8)")).cast("double") / F.count(c)).cast("decimal(28,8)")
    out = rows.groupBy(*keys).agg(mean(x).alias("mean"), F.stddev_pop(x).alias("std"), F.max("__cut").alias("cut"), F.max("__p95").alias("p95"), F.avg((x < 0).cast("double")).alias("p_loss"), mean(F.when(x <= F.col("__cut"), x)).alias("tail"))
    r = lambda c: F.round(c, 4)
    return out.select(*keys, r("mean").cast("double").alias("mean"), r("std").alias("std"), r("cut").alias("p05"), r("p95").alias("p95"), r(F.greatest(F.lit(0.0), -F.col("cut"))).alias("var"), F.greatest(F.lit(0.0), (-r("tail")).cast("double")).alias("cvar"), r(F.when(F.col("std") > 1e-9, F.col("mean").cast("double") / F.col("std"))).alias("sharpe"), r("p_loss").alias("p_loss"))


@query("""WITH p AS (SELECT l_suppkey AS supplier, l_extendedprice * (1 - l_discount) - l_quantity * 1100 AS profit FROM lineitem), q AS (SELECT supplier, quantile_cont(profit, 0.05) AS cut, (sum(profit::DECIMAL(28, 8))::DOUBLE / count(*))::DECIMAL(28, 8) AS mean, stddev_pop(profit) AS std, quantile_cont(profit, 0.95) AS p95, avg((profit < 0)::INT) AS p_loss FROM p GROUP BY 1),
t AS (SELECT supplier, (sum(profit::DECIMAL(28, 8))::DOUBLE / count(*))::DECIMAL(28, 8) AS tail FROM p JOIN q USING (supplier) WHERE profit <= cut GROUP BY 1)
SELECT supplier, round(mean, 4)::DOUBLE AS mean, round(std, 4) AS std, round(cut, 4) AS p05, round(p95, 4) AS p95, round(greatest(0.0, -cut), 4) AS var, greatest(0, -round(tail, 4))::DOUBLE AS cvar, round(CASE WHEN std > 1e-9 THEN mean::DOUBLE / std END, 4) AS sharpe, round(p_loss, 4) AS p_loss FROM q JOIN t USING (supplier)""")
def supplier_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25-A29, M6."""
    profit = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * 1100
    return profit_risk(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), profit.alias("profit")), ["supplier"], "profit")
