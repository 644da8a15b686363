"""Decisions on parts: contexts from sales and suppliers, norms, rules, plans, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import quantile, ranked
from ..plans.dispatch import dispatch
from ..plans.norms import evaluate
from ..plans.purchase import order, score_suppliers
from ..registry import query
from ..sources.readers import table

_DECISIONS = """d AS (SELECT l_partkey AS part, l_suppkey AS supplier, max(l_extendedprice) AS monto_usd, max(l_quantity) AS cantidad, max(l_discount) * 200 AS descuento_volumen_pct, count(*) AS n, min(l_linenumber) AS line
FROM lineitem GROUP BY 1, 2), x AS (SELECT d.*, p_size, p_type, s_nationkey, count(*) OVER (PARTITION BY part) AS proveedores FROM d JOIN part ON p_partkey = part JOIN supplier ON s_suppkey = supplier)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase decision for each part and supplier, built from the tables."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.max("l_extendedprice").alias("monto_usd"), F.max("l_quantity").alias("cantidad"), (F.max("l_discount") * 200).alias("descuento_volumen_pct"), F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("line"))
    n_suppliers = d.groupBy("part").agg(F.count(F.lit(1)).alias("proveedores_disponibles"))
    x = d.join(n_suppliers, "part").join(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "part"), "part").join(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "supplier"), "supplier")
    return x.select(
        "part", "supplier", F.lit("compra").alias("tipo"), F.to_timestamp(F.lit("2026-12-01 00:00:00")).alias("now"), "monto_usd", "cantidad", "descuento_volumen_pct", F.col("proveedores_disponibles").cast("double").alias("proveedores_disponibles"),
        (F.col("p_type") == "PROMO").alias("perecedero"), F.col("p_size").cast("double").alias("shelf_life_dias"), F.lit(20.0).alias("lead_time_dias"), (F.col("line") % 2 == 0).alias("aprobacion_supervisor"), F.lit(8000.0).alias("budget_disponible_categoria_usd"),
        (F.col("supplier") % 37 != 0).alias("proveedor_activo"), (F.col("s_nationkey") != 3).alias("proveedor_exterior"), (F.col("p_size") % 7).cast("double").alias("dias_hasta_evento"), F.lit(2.0).alias("lead_time_proveedor_dias"), (F.col("p_size") > 40).alias("sku_critico"), (F.col("n") == 1).alias("proveedor_es_nuevo"), (F.col("line") > 3).alias("justificacion_escrita"),
        (F.col("p_size") % 10).cast("double").alias("exceso_budget_pct"), F.lit(10.0).alias("moq_unidades"), (F.col("part") % 11 == 0).alias("sku_piloto"),
    )


@query(f"""WITH {_DECISIONS}, f AS (SELECT part, supplier, list_filter([
  CASE WHEN p_type = 'PROMO' AND 20 >= p_size THEN 'F_compra_perecedero_sin_viabilidad' END, CASE WHEN monto_usd > 5000 AND line % 2 <> 0 THEN 'F_compra_grande_sin_aprobacion_presupuesto_bajo' END, CASE WHEN supplier % 37 = 0 THEN 'F_compra_a_proveedor_desactivado' END, CASE WHEN s_nationkey <> 3 AND p_size % 7 < 2 THEN 'F_importacion_sin_lead_time_para_evento' END], lambda x: x IS NOT NULL) AS f,
  list_filter([CASE WHEN p_size > 40 AND proveedores < 2 THEN 'O_sku_critico_dos_proveedores' END, CASE WHEN s_nationkey <> 3 AND n = 1 AND line <= 3 THEN 'O_justificacion_proveedor_exterior_nuevo' END], lambda x: x IS NOT NULL) AS o,
  list_filter([CASE WHEN p_size % 10 > 0 THEN 'P_excede_budget_categoria_15_temporada_pico' END, CASE WHEN cantidad > 10 AND descuento_volumen_pct >= 10 THEN 'P_compra_supera_moq_con_descuento_volumen' END, CASE WHEN part % 11 = 0 THEN 'P_relajar_stock_minimo_sku_piloto' END], lambda x: x IS NOT NULL) AS p FROM x)
SELECT part, supplier, array_to_string(list_sort(f || o || p), ',') AS applied, array_to_string(list_sort(f), ',') AS blocked_by, CASE WHEN len(f) > 0 THEN 'blocked' WHEN len(o) > 0 THEN 'conditional' ELSE 'permitted' END AS verdict FROM f""")
def norm_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All norms on all decisions, as one projection."""
    return evaluate(decisions(spark, sf_dir)).select("part", "supplier", F.array_join("applied", ",").alias("applied"), F.array_join("blocked_by", ",").alias("blocked_by"), "verdict")


_CONTEXTS = """c AS (SELECT p_partkey AS part, CASE p_partkey % 3 WHEN 0 THEN 'existing' WHEN 1 THEN 'new' ELSE 'trending' END AS tipo_sku, p_size * 2 AS semanas, p_size % 10 / 10.0 AS vol, (p_size % 13) / 13.0 AS sim, (p_size % 11) / 11.0 AS trend, p_size % 9 = 0 AS evento, p_size % 17 = 0 AS stopped FROM part)"""


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(F.col("p_partkey") % 3 == 0, "existing").when(F.col("p_partkey") % 3 == 1, "new").otherwise("trending")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), kind.alias("tipo_sku"), (size * 2).alias("semanas_historia"), (size % 10 / 10.0).alias("volatilidad_forecast"), (size % 13 / 13.0).alias("similar_top_score"), F.lit("S1").alias("similar_top_sku"), (size % 13 / 13.0).alias("cold_start_confidence"), (size % 11 / 11.0).alias("trend_confidence"), (size % 9 == 0).alias("evento_dentro_de_lead_time"), (size % 17 == 0).alias("stopped"))


@query(f"""WITH {_CONTEXTS}, r AS (SELECT *, CASE WHEN stopped THEN NULL WHEN tipo_sku = 'existing' AND semanas >= 52 AND vol < 0.3 THEN 'regla_001_existing_estable' WHEN evento AND tipo_sku = 'existing' AND semanas >= 52 THEN 'regla_030_evento_proximo_lead_time'
WHEN tipo_sku = 'existing' AND semanas >= 52 THEN 'regla_002_existing_volatil' WHEN tipo_sku = 'new' AND sim >= 0.7 THEN 'regla_010_cold_start_similar_alto' WHEN tipo_sku = 'trending' AND trend >= 0.8 THEN 'regla_020_trend_signal_alta_confidence' WHEN tipo_sku = 'new' AND sim < 0.5 THEN 'regla_011_cold_start_similar_dudoso'
WHEN tipo_sku = 'existing' AND semanas >= 12 THEN 'regla_003_existing_historia_corta' WHEN tipo_sku = 'trending' AND semanas >= 52 THEN 'regla_021_trend_signal_dudosa' ELSE 'regla_999_fallback' END AS rule FROM c),
b AS (SELECT *, CASE left(rule, 9) WHEN 'regla_001' THEN 0.9 WHEN 'regla_030' THEN 0.78 WHEN 'regla_002' THEN 0.8 WHEN 'regla_010' THEN 0.65 WHEN 'regla_020' THEN 0.75 WHEN 'regla_011' THEN 0.4 WHEN 'regla_003' THEN 0.65 WHEN 'regla_021' THEN 0.7 WHEN 'regla_999' THEN 0.3 END::DOUBLE AS base FROM r)
SELECT part, rule, round(CASE WHEN tipo_sku = 'new' AND sim < 0.7 THEN base * greatest(0.3, sim) WHEN tipo_sku = 'trending' AND trend >= 0.8 THEN least(1.0, base * 1.05) ELSE base END, 6)::DOUBLE AS confidence FROM b""")
def dispatched_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of each context; blocked contexts have none."""
    return dispatch(contexts(spark, sf_dir), blocked=F.col("stopped")).select("part", "rule", "confidence")


@query("""WITH a AS (SELECT l_partkey AS part, l_suppkey AS supplier, round(avg(l_extendedprice / l_quantity), 4) AS price, 1 + l_suppkey % 60 AS lead, (l_suppkey % 10) / 10.0 AS rel FROM lineitem GROUP BY 1, 2), s AS (SELECT *, round(0.5 * rel + 0.3 / (1 + lead / 30.0) + 0.2 * (1 - price / max(price) OVER (PARTITION BY part)), 9) AS score FROM a)
SELECT part, supplier, round(score, 4)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, supplier) AS place FROM s) WHERE place = 1""")
def chosen_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best supplier of each part."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("price"))
    a = a.withColumn("lead_days", 1 + F.col("supplier") % 60).withColumn("reliability", F.col("supplier") % 10 / 10.0)
    return score_suppliers(a, ["part"]).where("place = 1").select("part", "supplier", F.round("score", 4).alias("score"))


@query("""WITH w AS (SELECT l_partkey AS part, l_quantity AS q, l_extendedprice / l_quantity AS p FROM lineitem), f AS (SELECT part, avg(q) AS mean, quantile_cont(q, 0.05) AS p5, quantile_cont(q, 0.95) AS p95, round(avg(p), 2) AS price FROM w GROUP BY 1),
o AS (SELECT part, price, least(round_even(round_even(mean, 0) * 1.2, 0), floor(40000 / price))::BIGINT AS quantity, round_even(p5, 0)::BIGINT AS low, round_even(round_even(p95, 0) * 1.2, 0)::BIGINT AS high FROM f)
SELECT part, quantity, least(low, quantity) AS quantity_p5, greatest(high, quantity) AS quantity_p95, round(price * quantity, 2) AS cost, round(greatest(0, price * (greatest(high, quantity) - quantity)), 2)::DOUBLE AS var FROM o""")
def open_loop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-loop quantities under a buffer and a budget."""
    # Counted by quantity first: a part's percentiles need its distinct quantities, not its rows.
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    f = ranked(w, ["part"], "q", "n").groupBy("part").agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean"), quantile("q", 0.05).alias("p5"), quantile("q", 0.95).alias("p95"), F.round(F.sum("p") / F.sum("n"), 2).alias("price"))
    f = f.withColumns({"p50": F.col("mean"), "std": F.lit(0.0), "confidence": F.lit(0.8), "budget": F.lit(40000.0), "buffer": F.lit(1.2), "perishable": F.lit(False)})
    return order(f, "open_loop").select("part", "quantity", "quantity_p5", "quantity_p95", "cost", "var")


@query(f"""WITH {_CONTEXTS} SELECT tipo_sku AS category, CASE WHEN semanas >= 52 THEN 'affine' ELSE 'open' END AS algorithm, count(*) AS n FROM c GROUP BY 1, 2""")
def algorithms_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of decisions by category and algorithm."""
    return contexts(spark, sf_dir).groupBy(F.col("tipo_sku").alias("category"), F.when(F.col("semanas_historia") >= 52, "affine").otherwise("open").alias("algorithm")).agg(F.count(F.lit(1)).alias("n"))
