"""Reports and derived tables: hierarchies, product texts, monthly behaviour, season curves, derived catalogue, contracts, restrictions, affine inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import trends as X
from ..plans import affine, restrictions
from ..plans.inference import closure
from ..registry import query
from ..sources.files import signal_errors
from ..sources.readers import table
from ..sources.shared import tasks_for
from .catalog import _STOCK, purchases, stock


@query("""SELECT r_name AS region, n_name AS nation, p_type AS category, count(DISTINCT p_partkey) AS n_parts FROM part JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE l_quantity >= 1 GROUP BY 1, 2, 3""")
def hierarchy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that moved, by the levels above them; one inner and three outer joins.

    Lines are dealt by part, once: parts are made distinct for each supplier,
    met and counted where they are.
    """
    t = lambda name: table(spark, sf_dir, name)
    tasks = tasks_for(spark, t("lineitem").count())
    moved = t("lineitem").where("l_quantity >= 1").select("l_partkey", "l_suppkey").repartition(tasks, "l_partkey", "l_suppkey").distinct().repartition(tasks, "l_partkey")
    out = moved.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = out.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("p_type").alias("category")).agg(F.countDistinct("l_partkey").alias("n_parts"))


@query(f"WITH s AS ({_STOCK}) SELECT p_partkey, stock FROM s ORDER BY stock DESC, p_partkey LIMIT 20")
def largest_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-20 report."""
    return stock(table(spark, sf_dir, "lineitem")).select("p_partkey", "stock").orderBy(F.desc("stock"), "p_partkey").limit(20)


@query("SELECT n_name AS name FROM nation WHERE n_name LIKE '%1%' OR n_name LIKE '%2%'")
def names_with_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain any of some words."""
    return table(spark, sf_dir, "nation").where(reduce(lambda a, b: a | b, (F.contains("n_name", F.lit(w)) for w in ("1", "2")))).select(F.col("n_name").alias("name"))


_BARE = r"regexp_replace(trim({}), '(\s*\.)+\s*$', '')"


@query(f"""WITH f AS (SELECT p_partkey, {_BARE.format('p_name')} AS a, {_BARE.format("split_part(p_name, ' ', 1)")} AS b, {_BARE.format('p_type')} AS c, {_BARE.format('p_brand')} AS g FROM part),
t AS (SELECT p_partkey, CASE WHEN a <> '' AND b <> '' AND NOT contains(upper(a), upper(b)) AND contains(upper(b), upper(a)) THEN b ELSE a END || '. ' || CASE WHEN a <> '' AND b <> '' AND (contains(upper(a), upper(b)) OR contains(upper(b), upper(a))) THEN '' ELSE b END || '. Categoria: ' || c || '. Grupo: ' || g || '. Origen: .' AS x FROM f)
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(x, '\\.[ .]*\\.', '.', 'g'), ' {{2,}}', ' ', 'g'), ':\\.', ':', 'g')) AS text FROM t""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of each part that is embedded."""
    return table(spark, sf_dir, "part").select("p_partkey", X.product_text(F.col("p_name"), F.split("p_name", " ")[0], F.col("p_type"), F.col("p_brand"), F.lit("")).alias("text"))


@query("""WITH m AS (SELECT l_partkey AS part, date_trunc('month', o_orderdate) AS month, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), s AS (SELECT part, sqrt(sum(q * q)) AS size FROM m GROUP BY 1),
p AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS b FROM part), d AS (SELECT a, b, sum(x.q * y.q) AS dot FROM p JOIN m x ON x.part = a JOIN m y ON y.part = b AND y.month = x.month GROUP BY 1, 2)
SELECT p.a, p.b, CASE WHEN coalesce(u.size, 0) = 0 AND coalesce(v.size, 0) = 0 THEN 'missing_both' WHEN coalesce(u.size, 0) = 0 THEN 'missing_a' WHEN coalesce(v.size, 0) = 0 THEN 'missing_b' ELSE 'available' END AS flag,
round(CASE WHEN coalesce(u.size, 0) = 0 OR coalesce(v.size, 0) = 0 THEN 0 ELSE least(1, coalesce(dot, 0) / (u.size * v.size)) END, 6)::DOUBLE AS score
FROM p LEFT JOIN s u ON u.part = p.a LEFT JOIN s v ON v.part = p.b LEFT JOIN d ON d.a = p.a AND d.b = p.b WHERE p.b IS NOT NULL""")
def behavioural_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: cosine of the monthly sales of neighbouring parts of equal attributes, and which side has none.

    A part's months are one short array of (month, units); both sides are
    joined by their part and multiplied month by month, so sales are
    shuffled once.
    """
    monthly = purchases(spark, sf_dir).groupBy(F.col("l_partkey").alias("part"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("l_quantity").alias("q"))
    held = monthly.groupBy("part").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", "q")))).alias("sales"))
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey")).alias("b")).where("b is not null")
    side = lambda k: held.select(F.col("part").alias(k), F.col("size").alias(f"size_{k}"), F.col("sales").alias(f"sales_{k}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    no_a, no_b = (F.coalesce(f"size_{k}", F.lit(0.0)) == 0 for k in "ab")
    dot = F.aggregate(F.map_entries("sales_a"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("sales_b", e["key"]), F.lit(0.0)))
    flag = F.when(no_a & no_b, "missing_both").when(no_a, "missing_a").when(no_b, "missing_b").otherwise("available")
    return both.select("a", "b", flag.alias("flag"), F.round(F.when(flag == "available", F.least(F.lit(1.0), dot / (F.col("size_a") * F.col("size_b")))).otherwise(0.0), 6).alias("score"))


@query("""WITH w AS (SELECT p_partkey AS part, k, greatest(0.1, least(2, greatest(0, sin(2 * pi() * (k - 47) / 52) + 1)) * (1 + p_size / 50.0::DOUBLE) * 0.5 + 0.5) AS x FROM part, range(1, 53) r(k)), t AS (SELECT *, sum(x) OVER (PARTITION BY part) AS total FROM w)
SELECT part, k::INT AS week, round(x / total * 52, 6) AS factor FROM t""")
def season_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """52 weekly factors of each part."""
    curve = X.season_curve(1 + F.col("p_size") / 50.0, F.lit(0.5))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.posexplode(curve).alias("k", "x")).select("part", X.week_of_year(F.col("k") + 1).alias("week"), F.round("x", 6).alias("factor"))


@query(f"""WITH s AS ({_STOCK}) SELECT p.p_partkey AS sku, left(p_name, 48) AS short_name, round(p_retailprice::DECIMAL(12, 2) * 0.65::DECIMAL(3, 2), 2)::DOUBLE AS cost, lower(p_type) IN ('promo', '1', 'true', 'yes') AS perishable, coalesce(stock, 0)::BIGINT AS stock, 'GRP_' || p_type AS group_id
FROM part p LEFT JOIN s ON s.p_partkey = p.p_partkey""")
def derived_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product table that is derived from the catalogue and the stock; costs in decimals."""
    out = table(spark, sf_dir, "part").join(stock(table(spark, sf_dir, "lineitem")), "p_partkey", "left")
    return out.select(F.col("p_partkey").alias("sku"), F.substring("p_name", 1, 48).alias("short_name"), F.round(F.col("p_retailprice").cast("decimal(12,2)") * F.lit("0.65").cast("decimal(3,2)"), 2).cast("double").alias("cost"), F.lower("p_type").isin("promo", "1", "true", "yes").alias("perishable"), F.coalesce("stock", F.lit(0)).cast("long").alias("stock"), F.concat(F.lit("GRP_"), "p_type").alias("group_id"))


_SIGNALS = "CASE WHEN user_id % 7 = 0 THEN '' ELSE 'ev_' || event_id END AS trend_id, CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS descripcion, CASE WHEN event_type = 'click' THEN 'tik tok' WHEN event_type = 'view' THEN 'ig' ELSE event_type END AS fuente"


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 7 = 0 THEN 'trend_id' END, CASE WHEN event_type = 'error' THEN 'descripcion' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'fuente' END, CASE WHEN event_type = 'error' THEN 'fecha_deteccion' END,
CASE WHEN value / 100 NOT BETWEEN 0 AND 1 THEN 'confianza_extraccion' END, CASE WHEN value - 5 < 0 THEN 'velocidad_crecimiento' END], lambda x: x IS NOT NULL), ',') AS errors FROM events""")
def signal_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths at which each signal breaks the contract."""
    when = F.when(F.col("event_type") == "error", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "ts", "value", *(x.strip() for x in _SIGNALS.split(", CASE")[:1]), *(f"CASE{x}" for x in _SIGNALS.split(", CASE")[1:]))
    raw = raw.withColumns({"fecha_deteccion": when, "confianza_extraccion": F.col("value") / 100, "velocidad_crecimiento": F.col("value") - 5})
    return raw.select("event_id", F.array_join(signal_errors(), ",").alias("errors"))


@query("""WITH c AS (SELECT p_partkey AS part, p_retailprice * p_size / 4 AS budget, p_size / 50.0 AS vol, p_size / 40.0 AS trend, p_type = 'PROMO' AS perishable, p_size AS life, p_size / 60.0 AS conf, l.n, l.least FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, min(1 + l_suppkey % 60) AS least FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey)
SELECT part, array_to_string(list_filter([CASE WHEN budget < 5000 THEN 'N-STUB-001' END, CASE WHEN vol > 0.25 THEN 'N-STUB-002' END, CASE WHEN trend > 0.7 THEN 'N-STUB-003' END, CASE WHEN perishable AND life > 0 THEN 'N-STUB-004' END, CASE WHEN conf < 0.5 THEN 'N-STUB-005' END, 'N-STUB-006'], lambda x: x IS NOT NULL), ',') AS norms,
CASE WHEN perishable AND coalesce(least, 999) >= life THEN 'shelf_life' WHEN coalesce(n, 0) = 0 THEN 'no_supplier' WHEN budget <= 0 THEN 'no_budget' END AS blocked FROM c""")
def order_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restrictions of an order of each part, and why it may not be placed."""
    size = F.col("p_size")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.min(1 + F.col("l_suppkey") % 60).alias("least_lead"))
    rows = table(spark, sf_dir, "part").join(sold, "p_partkey", "left").withColumns({"budget": F.col("p_retailprice") * size / 4, "volatility": size / 50.0, "trend_confidence": size / 40.0, "perishable": F.col("p_type") == "PROMO", "shelf_life": size, "source": F.lit("inherited"), "confidence": size / 60.0})
    return rows.select(F.col("p_partkey").alias("part"), F.array_join(F.transform(restrictions.restrictions(), lambda r: r["norm"]), ",").alias("norms"), restrictions.blocked().alias("blocked"))


_RELATIONS = """r AS (SELECT l_partkey AS part, l_suppkey AS supplier, quantile_cont(l_quantity, 0.5) AS p50, stddev_pop(l_quantity) AS std, min(l_quantity) AS moq FROM lineitem GROUP BY 1, 2),
v AS (SELECT r.*, 7 + supplier % 40 AS lead_min, 14 + supplier % 40 AS lead_max, (supplier % 10) / 10.0::DOUBLE AS rel FROM r JOIN supplier ON s_suppkey = supplier WHERE s_acctbal > 0 AND 14 + supplier % 40 + 5 <= 45)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, their suppliers and terms."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    q, n = F.col("q"), F.col("n")
    mean = F.sum(q * n) / F.sum(n)
    r = w.groupBy("part", "supplier").agg(F.percentile("q", 0.5, n).alias("p50"), F.sqrt(F.greatest(F.lit(0.0), F.sum(q * q * n) / F.sum(n) - mean * mean)).alias("std"), F.min("q").alias("moq"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") > 0).alias("active"))
    return r.join(s, "supplier").withColumns({"lead_min": 7 + F.col("supplier") % 40, "lead_max": 14 + F.col("supplier") % 40, "reliability": F.col("supplier") % 10 / 10.0})


@query(f"""WITH {_RELATIONS}, i AS (SELECT part, supplier, greatest(1, p50) AS demand, greatest(moq * 20, greatest(1, p50) * 3) AS capacity, (lead_min + lead_max) / 2.0::DOUBLE / 7 AS lead, greatest(0.2, least(1, rel)) AS service, greatest(1, std * 0.5) AS epsilon, greatest(1, std) AS sigma FROM v),
u AS (SELECT *, abs((1 - pow(exp(-0.15::DOUBLE), greatest(0, 8 - lead - u))) / (1 - exp(-0.15::DOUBLE)) - service) AS a FROM i, range(0, 8) t(u))
SELECT part, supplier, round(any_value(demand), 6) AS demand, round(any_value(capacity), 6) AS capacity, round(sum(epsilon * greatest(0, a - 1 / sigma)), 5) AS load, round(sum(epsilon * greatest(0, a - 1 / sigma)), 5) <= round(any_value(capacity), 6) AS feasible FROM u GROUP BY 1, 2""")
def affine_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the robust policy needs of each part and supplier, and whether the worst case fits."""
    out = affine.inputs(affine.viable(relations(spark, sf_dir), days_to_event=45))
    rounded = out.select("part", "supplier", F.round("demand", 6).alias("demand"), F.round("capacity", 6).alias("capacity"), F.round("load", 5).alias("load"))
    return rounded.withColumn("feasible", F.col("load") <= F.col("capacity"))


@query("""WITH s AS (SELECT s_suppkey AS supplier, s_nationkey AS plan, s_acctbal / 37 AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS w FROM supplier), q AS (SELECT *, round_even(greatest(0, x), 0)::BIGINT AS quantity, DATE '2026-03-01' + (14 + 7 * w)::INT AS arrival FROM s)
SELECT plan, supplier, quantity, round(quantity * 12.5::DOUBLE, 2) AS cost, arrival, round(greatest(0, (DATE '2026-04-15' - arrival) / 7.0::DOUBLE), 2) AS buffer_weeks FROM q WHERE quantity > 0""")
def affine_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solution's quantities as dated items."""
    w = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1
    solution = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("plan"), (F.col("s_acctbal") / 37).alias("x"), w.alias("w"), F.lit(12.5).alias("price"))
    return affine.items(solution, F.to_date(F.lit("2026-03-01")), F.to_date(F.lit("2026-04-15"))).select("plan", "supplier", "quantity", "cost", "arrival", "buffer_weeks")


@query("""WITH RECURSIVE e AS (SELECT 'customer/' || c_custkey AS child, 'nation/' || c_nationkey AS parent FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation UNION ALL SELECT 'region/' || r_regionkey, 'world' FROM region),
t AS (SELECT child AS member, parent AS ancestor, 1 AS hops FROM e UNION ALL SELECT t.member, e.parent, hops + 1 FROM t JOIN e ON e.child = t.ancestor) SELECT member, ancestor, hops FROM t""")
def transitive_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that each member belongs to, at any depth, and how many steps away it is."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, c: F.concat(F.lit(f"{kind}/"), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("member"), b.alias("ancestor"))
    edges = edge(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey")).unionByName(edge(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"))).unionByName(edge(t("region"), key("region", "r_regionkey"), F.lit("world")))
    return closure(edges)


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, first_value(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_partkey, l_linenumber) AS main FROM lineitem)
SELECT l_orderkey AS plan, main AS supplier, count(*) AS n_items, round(sum(l_extendedprice), 2) AS cost FROM i WHERE l_suppkey = main GROUP BY 1, 2""")
def main_supplier_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the costliest item's supplier delivers, of each plan (an order, a few items)."""
    item = F.struct(F.col("l_extendedprice").alias("cost"), F.col("l_suppkey").alias("supplier"))
    main = F.min(F.struct(-F.col("l_extendedprice"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")))["l_suppkey"]
    plans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.collect_list(item).alias("items"), main.alias("supplier"))
    own = plans.withColumn("own", X.of_supplier(F.col("items"), F.col("supplier")))
    return own.select("plan", "supplier", F.size("own").cast("long").alias("n_items"), F.round(F.aggregate("own", F.lit(0.0), lambda s, i: s + i["cost"]), 2).alias("cost"))
