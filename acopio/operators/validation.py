"""Shapes over triples of the tables, and guards of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import inference, shacl
from ..plans.vocabulary import VOCABULARY
from ..registry import query
from ..sources.graph import XSD
from ..sources.readers import table
from ..sources.shared import tasks_for

_PREFIXES = """@prefix : <urn:catalogue#> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix prov: <http://www.w3.org/ns/prov#> ."""
# What products, suppliers, norms, decisions and trend signals must have.
CATALOGUE_SHAPES = _PREFIXES + """
:ProductoShape a sh:NodeShape ; sh:targetClass :Producto ;
  sh:property [ sh:path :sku ; sh:minCount 1 ; sh:datatype xsd:string ; sh:pattern "^[A-Z0-9_-]+$" ; sh:message "sku: one of capitals, digits, - and _" ] ;
  sh:property [ sh:path :perteneceA ; sh:minCount 1 ; sh:class :Categoria ; sh:message "belongs to no category" ] .
:ProveedorShape a sh:NodeShape ; sh:targetClass :Proveedor ;
  sh:property [ sh:path :proveedorId ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 1 ; sh:message "one supplier id" ] ;
  sh:property [ sh:path :pais ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:pattern "^[A-Z]{2}$" ; sh:message "country of two capitals" ] .
:NormShape a sh:NodeShape ; sh:targetClass :Norm ;
  sh:property [ sh:path :priority ; sh:minInclusive 0 ; sh:maxInclusive 100 ; sh:message "priority in 0..100" ] ;
  sh:property [ sh:path :validFrom ; sh:lessThanOrEquals :validTo ; sh:message "valid from before valid to" ] ;
  sh:or ( [ sh:class :Obligation ] [ sh:class :Permission ] [ sh:class :Prohibition ] ) ; sh:message "one of three modalities" .
:DecisionShape a sh:NodeShape ; sh:targetClass :Decision ;
  sh:property [ sh:path prov:atTime ; sh:minCount 1 ; sh:datatype xsd:dateTime ; sh:message "a time" ] ;
  sh:property [ sh:path :invocaAlgoritmo ; sh:minCount 1 ; sh:class :Algorithm ; sh:message "an algorithm" ] ;
  sh:property [ sh:path :razonamiento ; sh:minCount 1 ; sh:datatype xsd:string ; sh:minLength 10 ; sh:message "a reason of ten characters" ] .
:TrendSignalShape a sh:NodeShape ; sh:targetClass :TrendSignal ;
  sh:property [ sh:path :confianzaExtraccion ; sh:minCount 1 ; sh:datatype xsd:decimal ; sh:minInclusive 0 ; sh:maxInclusive 1 ; sh:message "confidence in 0..1" ] .
"""
# The six properties of a trend signal that is taken in.
TREND_SHAPE = _PREFIXES + """
:TrendSignalShape a sh:NodeShape ; sh:targetClass :TrendSignal ; sh:property
  [ sh:path :descripcion ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 10 ; sh:maxLength 500 ; sh:message "description of 10 to 500 characters" ] ,
  [ sh:path :fuente ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:in ( "TIKTOK" "INSTAGRAM" "PINTEREST" "GOOGLE_TRENDS" "OTHER" ) ; sh:message "a known source" ] ,
  [ sh:path :fechaDeteccion ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:dateTime ; sh:message "one time of detection" ] ,
  [ sh:path :velocidadCrecimiento ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:float ; sh:minInclusive 0.0 ; sh:maxInclusive 1000.0 ; sh:message "growth in 0..1000" ] ,
  [ sh:path :confianzaExtraccion ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:float ; sh:minInclusive 0.0 ; sh:maxInclusive 1.0 ; sh:message "confidence in 0..1" ] ,
  [ sh:path :provisional ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:boolean ; sh:message "provisional or not" ] .
"""


def _say(df: DataFrame, s: Column, p: str, o: Column, datatype: str | Column | None = None) -> DataFrame:
    kind = datatype if isinstance(datatype, Column) else F.lit(datatype and XSD + datatype).cast("string")
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), kind.alias("datatype")).where("o is not null")


def _uri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"))


def catalogue_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, suppliers, norms, decisions and signals with their properties; what is odd about them is a stand-in made of the tables' columns."""
    part, supplier, orders, events = (table(spark, sf_dir, x) for x in ("part", "supplier", "orders", "events"))
    k, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    p, s, o, e, n = _uri("part", "p_partkey"), _uri("supplier", "s_suppkey"), _uri("decision", "o_orderkey"), _uri("signal", "event_id"), _uri("norm", "p_partkey")
    country = F.when(F.col("s_nationkey") % 5 == 0, "Py").when(F.col("s_nationkey") % 7 == 0, "PRY").otherwise("PY")
    called = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    start = F.to_date(F.lit("2026-01-01"))
    modality = F.when(kind == "PROMO", "Obligation").when(kind == "SMALL", "Permission").when(kind == "LARGE", "Prohibition").otherwise("Norm")
    said = (
        _say(part, p, "type", F.when(k % 2 == 0, "ProductoPerecedero").otherwise("Producto")), _say(part, p, "sku", F.when(k % 13 == 0, None).when(k % 11 == 0, F.concat(F.lit("sku "), k)).otherwise(F.concat(F.lit("SKU-"), k))),
        _say(part.where("p_size % 17 <> 0"), p, "perteneceA", F.concat(F.lit("categoria/"), kind)), _say(part.where("p_type <> 'ECONOMY'"), F.concat(F.lit("categoria/"), kind), "type", F.lit("Categoria")).distinct(),
        _say(supplier, s, "type", F.lit("Proveedor")), _say(supplier, s, "proveedorId", F.concat(F.lit("S"), F.col("s_suppkey"))), _say(supplier.where("s_suppkey % 9 = 0"), s, "proveedorId", F.concat(F.lit("T"), F.col("s_suppkey"))), _say(supplier, s, "pais", country),
        _say(part, n, "type", modality), _say(part, n, "priority", size * 3 - 10, "integer"), _say(part, n, "validFrom", F.date_add(start, size), "date"), _say(part, n, "validTo", F.lit("2026-02-10"), "date"),
        _say(orders, o, "type", F.lit("AlgorithmRecommendation")), _say(orders.where("o_orderstatus <> 'P'"), o, "atTime", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "dateTime"), _say(orders, o, "razonamiento", F.col("o_orderpriority")),
        _say(orders.join(called, "o_orderkey", "left_semi"), o, "invocaAlgoritmo", F.when(F.col("o_orderkey") % 37 == 0, "algorithm/none").otherwise("algorithm/open_loop")), _say(spark.range(1), F.lit("algorithm/open_loop"), "type", F.lit("Algorithm")),
        _say(events, e, "type", F.lit("TrendSignal")), _say(events.where("event_id % 41 <> 0"), e, "confianzaExtraccion", F.round(F.col("value") / 90, 4), F.when(F.col("event_id") % 50 == 0, XSD + "float").otherwise(XSD + "decimal")),
    )
    return reduce(DataFrame.unionByName, said)


@query("""WITH t AS (
SELECT 'ProductoShape' AS shape, 'part/' || p_partkey AS node, 'sku' AS path, CASE WHEN p_partkey % 13 = 0 THEN 'MinCount' ELSE 'Pattern' END AS component, 1 AS n, 'sku: one of capitals, digits, - and _' AS message FROM part WHERE p_partkey % 13 = 0 OR p_partkey % 11 = 0
UNION ALL SELECT 'ProductoShape', 'part/' || p_partkey, 'perteneceA', CASE WHEN p_size % 17 = 0 THEN 'MinCount' ELSE 'Class' END, 1, 'belongs to no category' FROM part WHERE p_size % 17 = 0 OR p_type = 'ECONOMY'
UNION ALL SELECT 'ProveedorShape', 'supplier/' || s_suppkey, 'proveedorId', 'MaxCount', 1, 'one supplier id' FROM supplier WHERE s_suppkey % 9 = 0
UNION ALL SELECT 'ProveedorShape', 'supplier/' || s_suppkey, 'pais', 'Pattern', 1, 'country of two capitals' FROM supplier WHERE s_nationkey % 5 = 0 OR s_nationkey % 7 = 0
UNION ALL SELECT 'NormShape', 'norm/' || p_partkey, 'priority', CASE WHEN p_size * 3 - 10 < 0 THEN 'MinInclusive' ELSE 'MaxInclusive' END, 1, 'priority in 0..100' FROM part WHERE p_size * 3 - 10 NOT BETWEEN 0 AND 100
UNION ALL SELECT 'NormShape', 'norm/' || p_partkey, 'validFrom', 'LessThanOrEquals', 1, 'valid from before valid to' FROM part WHERE DATE '2026-01-01' + p_size::INT > DATE '2026-02-10'
UNION ALL SELECT 'NormShape', 'norm/' || p_partkey, NULL, 'Or', 1, 'one of three modalities' FROM part WHERE p_type NOT IN ('PROMO', 'SMALL', 'LARGE')
UNION ALL SELECT 'DecisionShape', 'decision/' || o_orderkey, 'atTime', 'MinCount', 1, 'a time' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'DecisionShape', 'decision/' || o_orderkey, 'invocaAlgoritmo', CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'Class' ELSE 'MinCount' END, 1, 'an algorithm' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) OR o_orderkey % 37 = 0
UNION ALL SELECT 'DecisionShape', 'decision/' || o_orderkey, 'razonamiento', 'MinLength', 1, 'a reason of ten characters' FROM orders WHERE length(o_orderpriority) < 10
UNION ALL SELECT 'TrendSignalShape', 'signal/' || event_id, 'confianzaExtraccion', 'MinCount', 1, 'confidence in 0..1' FROM events WHERE event_id % 41 = 0
UNION ALL SELECT 'TrendSignalShape', 'signal/' || event_id, 'confianzaExtraccion', 'Datatype', 1, 'confidence in 0..1' FROM events WHERE event_id % 41 <> 0 AND event_id % 50 = 0
UNION ALL SELECT 'TrendSignalShape', 'signal/' || event_id, 'confianzaExtraccion', 'MaxInclusive', 1, 'confidence in 0..1' FROM events WHERE event_id % 41 <> 0 AND round(value / 90, 4) > 1)
SELECT * FROM t""")
def shape_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q6: what breaks the catalogue's shapes, subclasses and inferred members included."""
    rows = sum(n * table(spark, sf_dir, x).count() for x, n in (("part", 7), ("supplier", 3), ("orders", 4), ("events", 2)))  # triples, about
    return shacl.violations(catalogue_triples(spark, sf_dir), shacl.shapes(CATALOGUE_SHAPES), inference.axioms(VOCABULARY), tasks_for(spark, rows))


_SIGNAL = """SELECT event_id, CASE WHEN user_id % 7 = 0 THEN event_type ELSE event_type || ' seen by user ' || user_id END AS description, CASE event_type WHEN 'view' THEN 'TIKTOK' WHEN 'click' THEN 'PINTEREST' WHEN 'error' THEN 'FAX' ELSE 'OTHER' END AS source, value * 12 AS growth, value / 90 AS confidence FROM events"""


@query(f"""WITH s AS ({_SIGNAL}), m AS (SELECT event_id, list_filter([CASE WHEN confidence > 1 THEN 'confidence in 0..1' END, CASE WHEN source = 'FAX' THEN 'a known source' END, CASE WHEN length(description) < 10 THEN 'description of 10 to 500 characters' END, CASE WHEN growth > 1000 THEN 'growth in 0..1000' END, CASE WHEN event_id % 19 = 0 OR event_id % 23 = 0 THEN 'one time of detection' END, CASE WHEN event_id % 29 = 0 THEN 'provisional or not' END], lambda x: x IS NOT NULL) AS messages FROM s)
SELECT event_id, len(messages) = 0 AS valid, array_to_string(list_sort(messages), '; ') AS messages FROM m""")
def trend_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7-Q9, Q20: each signal as triples against the six properties of its shape: valid, or the distinct messages."""
    e, s = table(spark, sf_dir, "events"), _uri("signal", "event_id")
    k, kind = F.col("event_id"), F.col("event_type")
    source = F.when(kind == "view", "TIKTOK").when(kind == "click", "PINTEREST").when(kind == "error", "FAX").otherwise("OTHER")
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    said = reduce(DataFrame.unionByName, (
        _say(e, s, "type", F.lit("TrendSignal")), _say(e, s, "descripcion", F.when(F.col("user_id") % 7 == 0, kind).otherwise(F.concat(kind, F.lit(" seen by user "), F.col("user_id")))), _say(e, s, "fuente", source),
        _say(e.where("event_id % 19 <> 0"), s, "fechaDeteccion", at("ts"), "dateTime"), _say(e.where("event_id % 19 <> 0 and event_id % 23 = 0"), s, "fechaDeteccion", at(F.col("ts") + F.expr("interval 1 day")), "dateTime"),
        _say(e, s, "velocidadCrecimiento", F.col("value") * 12, "float"), _say(e, s, "confianzaExtraccion", F.col("value") / 90, "float"), _say(e, s, "provisional", F.lit("true"), F.when(k % 29 == 0, XSD + "string").otherwise(XSD + "boolean")),
    ))
    found = shacl.messages(shacl.violations(said, shacl.shapes(TREND_SHAPE), tasks=tasks_for(spark, 7 * e.count())))
    joined = e.select("event_id", s.alias("node")).join(found, "node", "left").withColumn("messages", F.coalesce("messages", F.array().cast("array<string>")))
    return joined.select("event_id", (F.size("messages") == 0).alias("valid"), F.array_join("messages", "; ").alias("messages"))


def score_errors(scores: dict[str, Column], low: float = -0.001, high: float = 1.001) -> Column:
    """Q14: the names of scores outside low..high; a score that is missing is none."""
    return F.array_compact(F.array(*(F.when(~c.between(low, high), name) for name, c in scores.items())))


def quantile_errors(names: list[str]) -> Column:
    """Q16: the pairs of quantiles that fall, in order; a missing one breaks no order."""
    return F.array_compact(F.array(*(F.when(F.col(a) > F.col(b), f"{a}>{b}") for a, b in zip(names, names[1:], strict=False))))


@query("""WITH q AS (SELECT l_partkey AS part, l_suppkey AS supplier, min(l_quantity) AS p5, quantile_cont(l_quantity, 0.25) AS p25, avg(l_quantity) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS p95, sum(l_discount) * 10 AS lexical, avg(l_tax) * 12 AS structural FROM lineitem GROUP BY 1, 2)
SELECT part, supplier, array_to_string(list_filter([CASE WHEN p5 > p25 THEN 'p5>p25' END, CASE WHEN round(p25, 6) > round(p50, 6) THEN 'p25>p50' END, CASE WHEN round(p50, 6) > round(p75, 6) THEN 'p50>p75' END, CASE WHEN p75 > p95 THEN 'p75>p95' END], lambda x: x IS NOT NULL), ',') AS falling,
array_to_string(list_filter([CASE WHEN round(lexical, 6) NOT BETWEEN -0.001 AND 1.001 THEN 'lexical' END, CASE WHEN round(structural, 6) NOT BETWEEN -0.001 AND 1.001 THEN 'structural' END], lambda x: x IS NOT NULL), ',') AS out_of_range FROM q""")
def guarded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14, Q16: the guards of similarity scores and of forecast quantiles, on records of each part and supplier.

    The mean stands in for the median, so that quantiles can fall, and sums of discounts for scores.
    """
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(
        F.min("l_quantity").alias("p5"), F.round(F.percentile("l_quantity", 0.25), 6).alias("p25"), F.round(F.avg("l_quantity"), 6).alias("p50"), F.round(F.percentile("l_quantity", 0.75), 6).alias("p75"), F.max("l_quantity").alias("p95"),
        F.round(F.sum("l_discount") * 10, 6).alias("lexical"), F.round(F.avg("l_tax") * 12, 6).alias("structural"))
    return q.select("part", "supplier", F.array_join(quantile_errors(["p5", "p25", "p50", "p75", "p95"]), ",").alias("falling"), F.array_join(score_errors({c: F.col(c) for c in ("lexical", "structural")}), ",").alias("out_of_range"))
