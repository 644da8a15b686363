"""Catalogue, supplier and purchase queries.

part is the product, p_type its category, supplier the supplier, orders and
lineitem the header and detail of purchases and sales.  Ties are settled by
keys throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.readers import table
from ..sources.shared import tasks_for

_STOCK = "SELECT l_partkey AS p_partkey, sum(greatest(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END, 0)) AS stock FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1"


def stock(lineitem: DataFrame) -> DataFrame:
    """A4: stock of a part; negative movements count as 0."""
    moved = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return lineitem.where("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.greatest(moved, F.lit(0.0))).alias("stock"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and detail rows."""
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query("""
SELECT l_partkey AS part, l_suppkey AS supplier, last_date, last_price, last_quantity, total_quantity, n_lines FROM (
  SELECT l_partkey, l_suppkey, o_orderdate AS last_date, l_extendedprice AS last_price, l_quantity AS last_quantity,
         sum(l_quantity) OVER w AS total_quantity, count(*) OVER w AS n_lines,
         row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) AS rn
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_partkey, l_suppkey)) WHERE rn = 1""")
def supplier_last_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last terms and totals of each (part, supplier), in one aggregation."""
    last = F.max(F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")).alias("last")
    out = purchases(spark, sf_dir).groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(last, F.sum("l_quantity").alias("total_quantity"), F.count(F.lit(1)).alias("n_lines"))
    return out.select("part", "supplier", F.col("last.o_orderdate").alias("last_date"), F.col("last.l_extendedprice").alias("last_price"), F.col("last.l_quantity").alias("last_quantity"), "total_quantity", "n_lines")


@query("""SELECT l_partkey AS part, l_extendedprice AS price, o_orderdate AS sold FROM (
SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE rn = 1""")
def last_sale_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last sale of each part by ROW_NUMBER = 1."""
    w = Window.partitionBy("l_partkey").orderBy(F.desc("o_orderdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice"))
    return purchases(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("o_orderdate").alias("sold"))


def card(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """A missing level leaves the lower ones."""
    out = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.trim("c_name").alias("name"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT c_custkey, trim(c_name) AS name, n_name AS nation, r_name AS region FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def hierarchy_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer hierarchy of each customer."""
    return card(*(table(spark, sf_dir, t) for t in ("customer", "nation", "region")))


@query(f"""WITH s AS ({_STOCK}) SELECT r_name AS region, n_name AS nation, count(DISTINCT p.p_partkey) AS n_parts, sum(CASE WHEN s.stock >= 1 THEN 1 ELSE 0 END)::BIGINT AS n_in_stock
FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN s ON s.p_partkey = p.p_partkey GROUP BY 1, 2""")
def hierarchy_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner hierarchy with counts of members; a null flag counts 0."""
    lines = table(spark, sf_dir, "lineitem")
    out = lines.join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(stock(lines), "p_partkey", "left")
    return out.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.countDistinct("p_partkey").alias("n_parts"), F.sum(F.when(F.col("stock") >= 1, 1).otherwise(0)).alias("n_in_stock"))


@query(f"""WITH s AS ({_STOCK}) SELECT p_type AS category, count(*) AS n_parts, count(*) FILTER (coalesce(stock, 0) >= 1) AS n_in_stock FROM part LEFT JOIN s USING (p_partkey) GROUP BY 1""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and parts in stock of each category."""
    out = table(spark, sf_dir, "part").join(stock(table(spark, sf_dir, "lineitem")), "p_partkey", "left")
    return out.groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(F.coalesce("stock", F.lit(0)) >= 1).alias("n_in_stock")).orderBy(F.desc("n_parts"), "category")


@query(f"""WITH s AS ({_STOCK}), l AS (SELECT l_partkey, max(o_orderdate) AS last_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT p.p_partkey, p_name, p_type AS category, last_date FROM part p LEFT JOIN s ON s.p_partkey = p.p_partkey LEFT JOIN l ON l_partkey = p.p_partkey
WHERE coalesce(stock, 0) < 150 ORDER BY last_date DESC NULLS LAST, p.p_partkey LIMIT 50""")
def reorder_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top-50 report of parts to reorder, those with a date first."""
    last = purchases(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("o_orderdate").alias("last_date"))
    out = table(spark, sf_dir, "part").join(stock(table(spark, sf_dir, "lineitem")), "p_partkey", "left").join(last, "p_partkey", "left")
    return out.where(F.coalesce("stock", F.lit(0)) < 150).select("p_partkey", "p_name", F.col("p_type").alias("category"), "last_date").orderBy(F.desc_nulls_last("last_date"), "p_partkey").limit(50)


@query("""SELECT s1 AS supplier, s2 AS other, count(DISTINCT p1_type) AS n_categories FROM (
SELECT DISTINCT e1.l_suppkey AS s1, e2.l_suppkey AS s2, p1.p_type AS p1_type FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 50 = 0) e1
JOIN part p1 ON p1.p_partkey = e1.l_partkey JOIN part p2 ON p1.p_type = p2.p_type AND p1.p_partkey <> p2.p_partkey
JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) e2 ON e2.l_partkey = p2.p_partkey AND e2.l_suppkey <> e1.l_suppkey) GROUP BY 1, 2""")
def similar_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other suppliers of a supplier's categories, through different parts.

    A search: every supplier whose key is divisible by 50, against all.

    Suppliers meet on a category if one of them has a part there that is not
    the other's only part, so counts of parts stand for the pairs of parts.
    """
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    held = pairs.groupBy("l_suppkey", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("one"))
    given = held.where("l_suppkey % 50 = 0").select(F.col("l_suppkey").alias("supplier"), "p_type", F.col("n").alias("n1"), F.col("one").alias("one1"))
    met = given.join(held, "p_type").where("supplier <> l_suppkey and not (n1 = 1 and n = 1 and one1 = one)")
    return met.groupBy("supplier", F.col("l_suppkey").alias("other")).agg(F.count(F.lit(1)).alias("n_categories"))


@query("""SELECT p_partkey, p_name FROM part WHERE p_retailprice > 1400 OR EXISTS (SELECT 1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey = p_partkey AND o_orderdate >= TIMESTAMP '1998-06-01')
OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1998-10-01')""")
def active_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A disjunction of conditions and EXISTS, as flags in one aggregation of the purchases."""
    flags = purchases(spark, sf_dir).where((F.col("o_orderdate") >= "1998-06-01") | (F.col("l_shipdate") >= "1998-10-01")).select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("recent", F.lit(True))
    return table(spark, sf_dir, "part").join(flags, "p_partkey", "left").where((F.col("p_retailprice") > 1400) | F.col("recent")).select("p_partkey", "p_name")


@query("""SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_name <> 'NATION_3') THEN 'true' ELSE 'false' END AS foreign_supplier
FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10))""")
def foreign_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CASE WHEN EXISTS over suppliers IN (… IN (…))."""
    parts = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    sold = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    abroad = table(spark, sf_dir, "nation").where("n_name <> 'NATION_3'").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("true").alias("abroad"))
    return table(spark, sf_dir, "supplier").join(sold, "s_suppkey", "left_semi").join(abroad, "s_nationkey", "left").select("s_suppkey", F.coalesce("abroad", F.lit("false")).alias("foreign_supplier"))


@query("""SELECT p_partkey, CASE WHEN upper(p_type) IN ('PROMO', 'ECONOMY') THEN 'true' ELSE 'false' END AS perishable, coalesce(nullif(trim(p_name), ''), '(sin nombre)') AS name FROM part""")
def perishable_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set membership as text, and defaults."""
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.upper("p_type").isin("PROMO", "ECONOMY"), "true").otherwise("false").alias("perishable"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.lit("(sin nombre)")).alias("name"))


@query("""SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS n_parts, count(*) AS n_lines, max(o_orderdate) AS last_date, count(DISTINCT (l_partkey, l_returnflag)) AS n_part_flags
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def supplier_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of distinct parts and lines, and the last date.

    Lines are dealt by supplier and part and counted there; what meets at a supplier are sums of its parts.
    """
    lines = purchases(spark, sf_dir).select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"), "l_returnflag", "o_orderdate").repartition(tasks_for(spark, table(spark, sf_dir, "lineitem").count()), "supplier", "part")
    flags = lines.groupBy("supplier", "part", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last"))
    parts = flags.groupBy("supplier", "part").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.count("l_returnflag").alias("flags"))
    return parts.groupBy("supplier").agg(F.count("part").alias("n_parts"), F.sum("n").alias("n_lines"), F.max("last").alias("last_date"), F.coalesce(F.sum(F.when(F.col("part").isNotNull(), F.col("flags"))), F.lit(0)).alias("n_part_flags"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) ON l_partkey = p_partkey WHERE p_partkey IS NULL""")
def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose part is not in the catalogue, as rows."""
    known = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(known, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT a.p_partkey AS part, b.p_partkey AS substitute, b.rn AS place FROM part a JOIN (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS rn FROM part) b
ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE b.rn <= 5""")
def substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five parts of a part's category and brand, itself left out afterwards, so that those five have four; J19 is category_substitutes."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    first = part.withColumn("place", F.row_number().over(Window.partitionBy("p_type", "p_brand").orderBy("p_partkey"))).where("place <= 5").withColumnRenamed("p_partkey", "substitute")
    return part.join(first, ["p_type", "p_brand"]).where("p_partkey <> substitute").select(F.col("p_partkey").alias("part"), "substitute", "place")


@query("""SELECT a.p_partkey AS part, b.p_partkey AS substitute, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS place FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey <> b.p_partkey QUALIFY place <= 5""")
def category_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five other parts of a part's category; six are kept before the join, as one may be the part itself."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    first = part.withColumn("rn", F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))).where("rn <= 6").withColumnRenamed("p_partkey", "substitute")
    pairs = part.join(F.broadcast(first), "p_type").where("p_partkey <> substitute")
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy("substitute"))
    return pairs.select(F.col("p_partkey").alias("part"), "substitute", place.alias("place")).where("place <= 5")


@query("""SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = 'PROMO' ORDER BY p_partkey LIMIT 20 OFFSET 20""")
def part_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a category's listing."""
    return table(spark, sf_dir, "part").where("p_type = 'PROMO'").select("p_partkey", "p_name", "p_retailprice").orderBy("p_partkey").offset(20).limit(20)


@query(f"""WITH s AS ({_STOCK}) SELECT s.p_partkey, coalesce(p_name, s.p_partkey::VARCHAR) AS name, stock FROM s LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p.p_partkey = s.p_partkey WHERE stock <= 120""")
def low_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the part's name, or its key."""
    named = table(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    return stock(table(spark, sf_dir, "lineitem")).where("stock <= 120").join(named, "p_partkey", "left").select("p_partkey", F.coalesce("p_name", F.col("p_partkey").cast("string")).alias("name"), "stock")


@query("""SELECT o_orderkey AS id, o_orderpriority AS name, o_orderdate::DATE::VARCHAR AS date, date_diff('day', DATE '1998-10-01', o_orderdate::DATE) AS days FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-10-01' AND DATE '1998-12-30'""")
def upcoming_events(spark: SparkSession, sf_dir: str, today: str = "1998-10-01", days: int = 90) -> DataFrame:
    """What the calendar of orders holds from today to today + days, both included, by date and key."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date"))
    now = F.to_date(F.lit(today))
    return rows.where(F.col("date").between(now, F.date_add(now, days))).orderBy("date", "id").select("id", "name", F.col("date").cast("string").alias("date"), F.datediff("date", now).cast("long").alias("days"))


@query("""WITH t AS (SELECT l_partkey, l_suppkey, max(o_orderdate) AS last_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT e.l_partkey AS part, e.l_suppkey AS supplier, s_name AS name, last_date, row_number() OVER (PARTITION BY e.l_partkey ORDER BY last_date DESC NULLS FIRST, e.l_suppkey) AS place
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) e JOIN supplier ON e.l_suppkey = s_suppkey LEFT JOIN t ON t.l_partkey = e.l_partkey AND t.l_suppkey = e.l_suppkey""")
def suppliers_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's suppliers by last date, unknown dates first."""
    lines = purchases(spark, sf_dir)
    last = lines.groupBy("l_partkey", "l_suppkey").agg(F.max(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))).alias("last_date"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc_nulls_first("last_date"), "l_suppkey")
    return last.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("s_name").alias("name"), "last_date", F.row_number().over(w).alias("place"))


@query("""SELECT 'p_size' AS name, count(*) AS n, count(DISTINCT p_size) AS n_distinct, count(*) FILTER (p_size IS NULL) AS n_null, count(*) FILTER (p_size = 0) AS n_zero, 0::BIGINT AS n_blank FROM part
UNION ALL SELECT 'p_name', count(*), count(DISTINCT p_name), count(*) FILTER (p_name IS NULL), 0, count(*) FILTER (trim(p_name) = '') FROM part
UNION ALL SELECT 'p_type', count(*), count(DISTINCT p_type), count(*) FILTER (p_type IS NULL), 0, count(*) FILTER (trim(p_type) = '') FROM part""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each column, all from one pass over the table."""
    part = table(spark, sf_dir, "part")
    kinds = dict(part.dtypes)
    said = lambda c: F.col(c) if kinds[c] == "string" else F.lit("x")
    cells = [F.struct(F.lit(c).alias("name"), F.count(F.lit(1)).alias("n"), F.countDistinct(c).alias("n_distinct"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_if(F.col(c).cast("string") == "0").alias("n_zero"), F.count_if(F.trim(said(c)) == "").alias("n_blank")) for c in ("p_size", "p_name", "p_type")]
    return part.agg(F.array(*cells).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")


@query("""SELECT coalesce(a.l_partkey, b.l_partkey) AS part, coalesce(a.l_suppkey, b.l_suppkey) AS supplier, CASE WHEN b.q IS NULL THEN 'removed' WHEN a.q IS NULL THEN 'added' ELSE 'modified' END AS change, coalesce(a.q, 0) AS before, coalesce(b.q, 0) AS after
FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) q FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1, 2) a FULL JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) q FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1, 2) b
ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.q IS DISTINCT FROM b.q""")
def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plans compared by (part, supplier): conditional sums of one pass instead of a full join."""
    year = F.year("l_shipdate")
    sums = table(spark, sf_dir, "lineitem").where(year.isin(1996, 1997)).groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.sum(F.when(year == 1996, F.col("l_quantity"))).alias("a"), F.sum(F.when(year == 1997, F.col("l_quantity"))).alias("b"))
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").otherwise("modified")
    return sums.where(~F.col("a").eqNullSafe(F.col("b"))).select("part", "supplier", change.alias("change"), F.coalesce("a", F.lit(0.0)).alias("before"), F.coalesce("b", F.lit(0.0)).alias("after"))
