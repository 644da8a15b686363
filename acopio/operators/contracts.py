"""Records between services: forecasts by method and their invariants, contexts from JSON, trend signals, correlation matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trends import season_curve, week_of_year
from ..plans.dispatch import dispatch
from ..registry import ORACLE_SQL, query
from ..sources.files import SOURCE_NAMES
from ..sources.readers import table
from .decisions import contexts
from .planning import ets_samples
from .scenarios import correlation, nearest_psd
from .weekly import filled_weeks, weekly

KINDS = ("existing", "new", "trending")


def forecast_faults() -> Column:
    """Q15: what breaks the contract of a forecast record.

    Columns: part, mean, std, p5, p50, p95 (arrays by week; null is empty),
    source, donor, n_own, confidence.
    """
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    lengths = [F.when(size(c) != size("mean"), f"length of {c}") for c in ("std", "p5", "p50", "p95")]
    inherited = F.col("source") == "inherited"
    known = F.coalesce(F.col("source").isin("own", "inherited", "category_default", "trend_only"), F.lit(False))
    return F.array_compact(F.array(
        *lengths, F.when(~known, "source"), F.when(inherited & F.col("donor").isNull(), "donor is missing"), F.when(inherited & (F.col("donor") == F.col("part")), "donor is the part itself"),
        F.when(~F.coalesce(F.col("n_own") >= 0, F.lit(False)), "n_own"), F.when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence"),
    ))


@query("""WITH y AS (SELECT l_partkey AS part, year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT part, count(*) AS n, count(*) FILTER (n > 1) AS n_std, sum(n) AS n_own FROM y GROUP BY 1),
c AS (SELECT r.part, concat_ws(',', CASE WHEN n_std <> n THEN 'length of std' END, CASE WHEN r.part % 3 = 0 AND r.part % 4 = 0 THEN 'donor is missing' END, CASE WHEN r.part % 3 = 0 AND r.part % 4 = 1 THEN 'donor is the part itself' END, CASE WHEN p_size > 45 THEN 'confidence' END) AS faults FROM r JOIN part ON p_partkey = r.part) SELECT part, faults FROM c WHERE faults <> ''""")
def faulty_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: records by year of each part; a year with one sale has no spread, and donors and confidences are stand-ins."""
    q = F.col("l_quantity")
    years = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.year("l_shipdate").alias("year")).agg(F.avg(q).alias("m"), F.stddev_samp(q).alias("s"), F.count(F.lit(1)).alias("n"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("year", F.col(c).alias("x"))))), lambda r: r["x"])
    r = years.groupBy("part").agg(listed("m").alias("mean"), listed("s").alias("std"), F.sum("n").alias("n_own"))
    part = F.col("part")
    donor = F.when(part % 4 == 1, part).when(part % 4 != 0, part + 1)
    r = r.withColumns({c: F.col("mean") for c in ("p5", "p50", "p95")} | {"source": F.when(part % 3 == 0, "inherited").otherwise("own"), "donor": donor})
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") / 45).alias("confidence"))
    return r.join(sizes, "part").withColumn("f", forecast_faults()).where(F.size("f") > 0).select("part", F.array_join("f", ",").alias("faults"))


def by_method(parts: DataFrame, series: DataFrame, ahead: int = 1, n_samples: int = 1000, seed: int = 42, least: int = 52) -> DataFrame:
    """the week ahead of each part from its own series of least weeks or more (ets), else from its level or its category's and the season (cold start).

    parts: part, category, curve (52 factors); series: part, year, week,
    units.  The target is so many weeks after the last one of all series.
    A part without sales in its category has level 5 and spread 3.
    """
    last = series.agg(F.max(F.col("year") * 52 + F.col("week")).alias("last"))
    own = series.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "week", F.col("units").cast("double").alias("x")))), lambda r: r["x"]).alias("y"))
    of = series.join(parts.select("part", "category"), "part").groupBy("category").agg(F.avg("units").alias("cat"), F.stddev_pop("units").alias("sd"))
    rows = parts.join(own, "part", "left").join(of, "category", "left").crossJoin(F.broadcast(last))
    mean = F.aggregate("y", F.lit(0.0), lambda s, x: s + x) / F.size("y")
    level = F.when(F.col("y").isNull() & F.col("cat").isNull(), 5.0).otherwise(F.greatest(F.lit(1.0), F.coalesce(mean, F.col("cat"))))
    target = week_of_year(F.coalesce("last", F.lit(0)) + ahead).cast("int")
    rows = rows.select("part", target.alias("week"), F.when(F.size("y") >= least, F.col("y")).alias("y"), (level * F.get("curve", target - 1)).alias("middle"), F.greatest(F.lit(1.0), 1.5 * F.coalesce("sd", F.lit(2.0))).alias("spread"))

    def forecast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Every part has the samples of the same seed.
        normal = np.random.default_rng(seed).standard_normal(n_samples)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ets = r.y is not None
                draws = ets_samples(np.asarray(r.y, float), ahead, n_samples, seed) if ets else np.maximum(0, max(0.0, r.middle) + r.spread * normal)
                out.append((r.part, r.week, "ets" if ets else "categoria_cold_start", ets, draws.mean(), max(0.01, draws.std()), *np.percentile(draws, [5, 25, 50, 75, 95])))
            yield pd.DataFrame(out, columns=["part", "week", "method", "calibrated", "mean", "std", "p5", "p25", "p50", "p75", "p95"])

    # The samples are the work, not the rows: as many tasks as shuffle partitions.
    dealt = rows.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    return dealt.mapInPandas(forecast, "part long, week int, method string, calibrated boolean, mean double, std double, p5 double, p25 double, p50 double, p75 double, p95 double")


@query()
def method_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week after the last one of each part; the season's peak and spread are stand-ins.  Rows only."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category"), season_curve(F.lit(2.0), F.lit(0.5)).alias("curve"))
    return by_method(parts, weekly(spark, sf_dir))


#: A context as JSON.
CONTEXT = """part long, tipo_sku string, semanas_historia int, volatilidad_forecast double, similar_top_score double, similar_top_sku string, cold_start_confidence double, trend_confidence double, evento_dentro_de_lead_time boolean,
similar_top_k array<struct<sku:string,score:double>>, evento_proximo struct<evento_id:string,dias:int>, evaluated_at timestamp, eval_deontica struct<permitida:boolean,bloqueada_por:array<string>,obligaciones_pendientes:array<string>>"""


def contexts_from_json(texts: DataFrame, column: str = "json") -> DataFrame:
    """Contexts as columns, beside the other columns of texts.

    A kind that is not known, or a text that is no object, makes the row one
    with an error; verdicts default to permitted, with no reasons.
    """
    none = F.array().cast("array<string>")
    d = texts.withColumn("_d", F.from_json(F.col(column), CONTEXT)).drop(column).select("*", "_d.*").drop("_d")
    verdict = F.when(F.col("eval_deontica").isNotNull(), F.struct(*(F.coalesce(F.col("eval_deontica")[k], default).alias(k) for k, default in (("permitida", F.lit(True)), ("bloqueada_por", none), ("obligaciones_pendientes", none)))))
    known = F.coalesce(F.col("tipo_sku").isin(*KINDS), F.lit(False))
    return d.withColumn("eval_deontica", verdict).withColumn("stopped", ~F.coalesce(F.col("eval_deontica.permitida"), F.lit(True))).withColumn("error", F.when(~known, "tipo_sku"))


@query("""SELECT p_partkey AS part, p_partkey % 13 = 0 AS wrong, CASE WHEN p_size % 17 = 0 OR p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 3 = 1 AND p_size % 13 / 13.0 >= 0.7 THEN 6 ELSE 5 END AS n_stages, CASE WHEN p_size % 17 = 0 THEN 1 ELSE 0 END AS n_reasons FROM part""")
def json_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts written as JSON, some of a kind that is not known, read back and dispatched."""
    c = contexts(spark, sf_dir).withColumn("tipo_sku", F.when(F.col("part") % 13 == 0, "otro").otherwise(F.col("tipo_sku")))
    verdict = F.when(F.col("stopped"), F.struct(F.lit(False).alias("permitida"), F.array(F.lit("N-1")).alias("bloqueada_por")))
    read = contexts_from_json(c.withColumn("eval_deontica", verdict).select(F.to_json(F.struct("*")).alias("json")))
    decided = dispatch(read, blocked=F.col("stopped") | F.col("error").isNotNull())
    stages = F.greatest(F.lit(0), F.coalesce(F.size("stages"), F.lit(0)))
    return decided.select("part", F.col("error").isNotNull().alias("wrong"), stages.alias("n_stages"), F.greatest(F.lit(0), F.coalesce(F.size("eval_deontica.bloqueada_por"), F.lit(0))).alias("n_reasons"))


def intake(signals: DataFrame) -> DataFrame:
    """ST10: canonical trend signals as the intake takes them; a source that is not known is OTHER, further columns go."""
    source = F.when(F.col("fuente").isin(*SOURCE_NAMES), F.col("fuente")).otherwise("OTHER")
    products = F.transform("productos_existentes_similares", lambda p: F.struct(p["sku"].cast("string").alias("sku"), p["score"].cast("double").alias("score"), p["nombre"].alias("nombre"), p["categoria"].alias("categoria"), p["precio_referencia"].cast("double").alias("precio_referencia")))
    return signals.select(
        "trend_id", "descripcion", "palabras_clave", source.alias("fuente"), "fecha_deteccion", "metadata_fuente", F.col("velocidad_crecimiento").cast("double").alias("velocidad_crecimiento"),
        F.col("confianza_extraccion").cast("double").alias("confianza_extraccion"), products.alias("productos_existentes_similares"), F.col("validado_shacl").cast("boolean").alias("validado_shacl"), F.col("provisional").cast("boolean").alias("provisional"),
    )


@query("""SELECT 'T' || event_id AS trend_id, CASE WHEN user_id % 3 = 0 THEN 'TIKTOK' WHEN user_id % 3 = 1 THEN 'PINTEREST' ELSE 'OTHER' END AS fuente, (user_id % 100)::VARCHAR AS sku, round(0.5 + user_id % 5 / 10.0, 2)::DOUBLE AS score, user_id % 2 = 0 AS provisional FROM events""")
def intake_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: events as trend signals, a third from a source that is not known."""
    u = F.col("user_id")
    product = F.struct((u % 100).alias("sku"), (0.5 + u % 5 / 10).alias("score"), F.lit("").alias("nombre"), F.lit("").alias("categoria"), F.lit(0).alias("precio_referencia"))
    s = table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), "event_id").alias("trend_id"), F.col("event_type").alias("descripcion"), F.array("event_type").alias("palabras_clave"), F.when(u % 3 == 0, "TIKTOK").when(u % 3 == 1, "PINTEREST").otherwise("MYSPACE").alias("fuente"), F.col("ts").alias("fecha_deteccion"),
        F.create_map(F.lit("user"), u.cast("string")).alias("metadata_fuente"), F.lit(1).alias("velocidad_crecimiento"), F.lit(0.5).alias("confianza_extraccion"), F.array(product).alias("productos_existentes_similares"), F.lit(0).alias("validado_shacl"), (1 - u % 2).alias("provisional"), u.alias("other"))
    p = F.get("productos_existentes_similares", F.lit(0))
    return intake(s).select("trend_id", "fuente", p["sku"].alias("sku"), F.round(p["score"], 2).alias("score"), "provisional")


#: The most names of one correlation matrix: its square is held by the driver.
MATRIX_NAMES = 2000


def correlations(filled: DataFrame, names: list[str], key: str = "category", value: str = "units", at: tuple[str, ...] = ("year", "week")) -> DataFrame:
    """M8: (a, b, correlation) of each pair of the names, both ways and with themselves; 0 for one without variance, 1 on the diagonal.

    filled: a value for each name and week.  The rows are the entries of the
    matrix, so names is a stated list of at most MATRIX_NAMES.
    """
    if len(names) > MATRIX_NAMES:
        raise ValueError(f"{len(names)} names; a matrix has at most {MATRIX_NAMES}")
    x = filled.where(F.col(key).isin(*names)).select(*at, F.col(key).alias("a"), F.col(value).cast("double").alias("x"))
    pairs = x.join(x.select(*at, F.col("a").alias("b"), F.col("x").alias("y")), list(at)).groupBy("a", "b").agg(correlation("x", "y").alias("r"))
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("correlation"))


def correlation_matrix(filled: DataFrame, names: list[str], **columns) -> np.ndarray:
    """M8, M9: the matrix of the names in their order, lifted to a positive one; a name without rows correlates with itself only."""
    place, matrix = {n: k for k, n in enumerate(names)}, np.eye(len(names))
    for r in correlations(filled, names, **columns).collect():
        matrix[place[r["a"]], place[r["b"]]] = r["correlation"]
    return matrix if len(names) == 1 else nearest_psd(matrix)


#: Of filled_correlations: the categories in the matrix.
CATEGORIES = ("PROMO", "SMALL", "LARGE", "ECONOMY", "STANDARD", "MEDIUM")


@query(f"""WITH f AS ({ORACLE_SQL['filled_weeks']}) SELECT a.category AS a, b.category AS b, CASE WHEN a.category = b.category THEN 1.0::DOUBLE ELSE round(coalesce(corr(a.units, b.units), 0), 4) END AS correlation FROM f a JOIN f b USING (year, week) GROUP BY 1, 2""")
def filled_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: entries of the matrix of the categories' weekly units, weeks without sales filled."""
    return correlations(filled_weeks(spark, sf_dir), list(CATEGORIES)).select("a", "b", F.round("correlation", 4).alias("correlation"))
