"""Robust affine purchase plans (O6) of orders and of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import affine, robust
from ..registry import query
from ..sources.readers import table
from ..sources.shared import written
from .recommend import forecasts


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, supplier, cents, moq, rate, demand, sell, last, total: the offers that deliver in time and bear their worst case."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber")
    terms = lines.groupBy("sku", "supplier").agg(F.floor(F.min(F.col("price") / F.col("q")) * 100).cast("long").alias("cents"), F.min("q").cast("long").alias("moq"))
    latest = lines.groupBy("sku").agg(F.max(F.struct("l_orderkey", "l_linenumber", F.col("q").cast("long").alias("q")))["q"].alias("latest"), F.sum(F.col("q").cast("long")).alias("sold"), F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") > 0).alias("active"), (7 + F.col("s_suppkey") % 40).alias("lead_min"), (14 + F.col("s_suppkey") % 40).alias("lead_max"), (F.col("s_suppkey") % 10 / 10.0).alias("reliability"))
    viable = affine.viable(terms.join(s, "supplier"), days_to_event=45).join(forecasts(spark, sf_dir).select("sku", "p50", "std"), "sku")
    good = affine.inputs(viable).where(F.round("load", 5) <= F.round("capacity", 6))
    sell = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").alias("sell"))
    d = F.greatest(F.lit(1), F.floor(F.col("p50") + 0.5).cast("long"))
    out = good.join(latest, "sku").join(sell, "sku").withColumn("d", d)
    return out.select("sku", "supplier", "cents", "moq", F.floor(F.col("service") * 10 + 0.5).cast("long").alias("rate"), F.col("d").alias("demand"), "sell", (F.col("latest") - F.col("d")).alias("last"), (F.col("sold") - F.col("n") * F.col("d")).alias("total"))


_OFFERS = """q AS (SELECT l_partkey AS sku, quantile_cont(l_quantity, 0.5) AS p50, round(sqrt(greatest(0, sum(l_quantity * l_quantity) / count(*) - (sum(l_quantity) / count(*)) * (sum(l_quantity) / count(*)))), 6) AS std, arg_max(l_quantity::BIGINT, (l_orderkey, l_linenumber)) AS latest, sum(l_quantity::BIGINT)::BIGINT AS sold, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT l_partkey AS sku, l_suppkey AS supplier, floor(min(l_extendedprice / l_quantity) * 100)::BIGINT AS cents, min(l_quantity)::BIGINT AS moq FROM lineitem GROUP BY 1, 2),
v AS (SELECT r.*, q.p50, q.std, q.latest, q.sold, q.n, greatest(1, floor(p50 + 0.5)::BIGINT) AS d, floor(p_retailprice * 100 + 0.5)::BIGINT AS sell, greatest(0.2::DOUBLE, (supplier % 10) / 10.0::DOUBLE) AS service, (21 + 2 * (supplier % 40)) / 2.0::DOUBLE / 7 AS lead FROM r JOIN q USING (sku) JOIN supplier ON s_suppkey = supplier JOIN part ON p_partkey = sku WHERE s_acctbal > 0 AND 14 + supplier % 40 + 5 <= 45),
g AS (SELECT sku, supplier FROM v, range(0, 8) t(u) GROUP BY sku, supplier, std, moq, p50 HAVING round(sum(greatest(1, std * 0.5) * greatest(0, abs((1 - pow(exp(-0.15::DOUBLE), greatest(0, 8 - lead - u))) / (1 - exp(-0.15::DOUBLE)) - service) - 1 / greatest(1, std))), 5) <= round(greatest(moq * 20, greatest(1, p50) * 3), 6)),
f AS (SELECT sku, supplier, cents, moq, floor(service * 10 + 0.5)::BIGINT AS rate, d, sell, latest - d AS last, sold - n * d AS total FROM v JOIN g USING (sku, supplier))"""
_MENU = """p AS (SELECT *, y0 * last + yi * total AS shift, greatest(0, 95 * d - w * (y0 * last + yi * total)) AS need FROM (SELECT sku, any_value(d) AS d, any_value(sell) AS sell, any_value(last) AS last, any_value(total) AS total, count(*) AS w, sum(cents)::BIGINT AS c, sum(rate)::BIGINT AS r, sum(cents * rate)::BIGINT AS cr FROM f GROUP BY sku), (VALUES (0, 0, 0), (1, 15, 5)) y(policy, y0, yi)),
b AS (SELECT sku, policy, share, cents * greatest(moq, (need * share + 9999) // 10000) AS cost, greatest(moq, (need * share + 9999) // 10000) AS x, supplier FROM p JOIN f USING (sku), (VALUES (50), (100)) z(share) WHERE need > 0 QUALIFY row_number() OVER (PARTITION BY sku, policy, share ORDER BY cost, x, supplier) = 1),
m AS (SELECT *, greatest(0, need - 100 * x) AS short, c * shift + 100 * cost AS spend FROM p JOIN (SELECT * FROM b UNION ALL SELECT sku, policy, 0, 0, 0, NULL FROM p) USING (sku, policy)),
k AS (SELECT sku, policy, share, shift >= 0 AS possible, short, spend, 10000 * spend + 25 * greatest(10000, 35 * sell) * short AS obj, -(sell * r * (100 * d - short)) AS a2, 10 * (spend + 3 * (w * shift + 100 * x)) - sell * r * (100 * d - short) AS a3, -(100 * cr * (100 * d - short) - 450 * spend + 4500 * cr * d) AS a4, sell * r * 100 * d AS most, 95 * d AS target FROM m)"""


@query(f"""WITH RECURSIVE {_OFFERS}, {_MENU},
w AS (SELECT DISTINCT l_orderkey AS plan, l_partkey AS sku FROM lineitem),
i AS (SELECT plan, policy, sku, dense_rank() OVER (PARTITION BY plan, policy ORDER BY sku) AS place, share, short, spend, obj, a2, a3, a4, most, target FROM w JOIN k USING (sku) QUALIFY bool_and(possible) OVER (PARTITION BY plan, policy)),
z AS (SELECT *, coalesce(sum(most) FILTER (share = 0) OVER (PARTITION BY plan, policy ORDER BY place RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS later FROM i),
l AS (SELECT plan, policy, sum(most)::BIGINT AS most, sum(target)::BIGINT AS target, count(*) AS n, any_value(floor(o_totalprice * 60)::BIGINT) AS budget FROM i JOIN orders ON o_orderkey = plan WHERE share = 0 GROUP BY 1, 2),
st AS (SELECT plan, policy, 0::BIGINT AS place, 0::HUGEINT AS code, 0::BIGINT AS obj, 0::BIGINT AS spend, 0::BIGINT AS a2, 0::BIGINT AS a3, 0::BIGINT AS a4, 0::BIGINT AS short FROM l
UNION ALL SELECT st.plan, st.policy, st.place + 1, st.code * 1000 + i.share, st.obj + i.obj, st.spend + i.spend, st.a2 + i.a2, st.a3 + i.a3, st.a4 + i.a4, st.short + i.short FROM st JOIN z i ON i.plan = st.plan AND i.policy = st.policy AND i.place = st.place + 1 JOIN l ON l.plan = st.plan AND l.policy = st.policy WHERE st.spend + i.spend <= 100 * l.budget AND st.a2 + i.a2 - i.later <= -(l.most * 50 // 100)),
e AS (SELECT st.*, target, n, budget, st.obj + CASE st.policy WHEN 0 THEN 200000 ELSE 0 END AS objective FROM st JOIN l ON l.plan = st.plan AND l.policy = st.policy AND st.place = n WHERE spend <= 100 * budget AND a2 <= -(most * 50 // 100) AND a3 <= 1000 * budget AND a4 <= 0),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY plan ORDER BY objective, policy, code) = 1)
SELECT DISTINCT w.plan, CASE WHEN best.plan IS NOT NULL THEN 'optimal' WHEN w.plan IN (SELECT plan FROM w JOIN f USING (sku)) THEN 'infeasible' ELSE 'no_offer' END AS status, best.policy, best.objective, best.spend, best.short, round(1 - best.short / best.target, 6) AS coverage, round(best.spend / (100 * best.budget) * 100, 4) AS budget_used_pct FROM w LEFT JOIN best ON best.plan = w.plan""")
def robust_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best robust affine plan of each order, at most 60 % of its value, at least half of the largest revenue.

    Orders of up to 13 parts are closed exactly; larger ones (at sf0.1 some ten)
    are bounded, with the best plan's objective only.  Objective in 1e-8,
    spending in 1e-4 of the currency, short in hundredths of a unit.
    """
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_partkey").alias("sku"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), F.floor(F.col("o_totalprice") * 60).cast("long").alias("budget"))
    best = robust.whole_plans(robust.nested(wanted, robust.part_lots(written(offers(spark, sf_dir), "offers")), orders), steps=2)
    status = F.when(F.col("objective").isNotNull(), "optimal").when(F.col("found").isNotNull(), "bounded").when(F.col("n_parts") > 0, "infeasible").otherwise("no_offer")
    return best.select("plan", status.alias("status"), F.col("policy").cast("int").alias("policy"), F.coalesce("objective", "found").alias("objective"), F.col("a1").alias("spend"), "short", F.round(1 - F.col("short") / F.col("target"), 6).alias("coverage"), F.round(F.col("a1") / (100 * F.col("budget")) * 100, 4).alias("budget_used_pct"))


@query()
def robust_plan_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound, plan and gap of the plans of customers (all parts of their orders), which are too large to multiply out."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("sku"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("plan"), F.floor(F.col("o_totalprice") * 60).cast("long").alias("budget"))
    held = robust.part_lots(written(offers(spark, sf_dir), "offers"))
    state = robust.whole_bounds(robust.nested(lines.join(orders, "l_orderkey").select("plan", "sku"), held, orders.groupBy("plan").agg(F.sum("budget").alias("budget"))))
    gap = (F.col("found") - F.col("bound")) / F.greatest(F.abs("bound"), F.lit(1.0))
    return state.select("plan", "policy", "n_parts", "bound", F.col("found").alias("objective"), F.round(gap, 6).alias("gap"))
