"""Scenarios and records: demand bands, cash-limited orders, what-if changes, correlated demand, provenance and replay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.dispatch import dispatch, stage_changes
from ..plans.purchase import whole
from ..registry import query
from ..sources.readers import table
from .decisions import contexts
from .weekly import weekly


def demand_bands(base: DataFrame, weeks: int = 8, z: float = 1.645) -> DataFrame:
    """level, volatility and trend of a part to weekly means with bands that widen with the horizon."""
    w = F.col("week")
    rows = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"))
    mean = F.col("level") * (1 + F.col("trend") * w)
    std = F.col("level") * F.col("volatility") * F.sqrt(1 + 0.05 * w)
    return rows.withColumn("mean", mean).withColumn("p05", F.greatest(F.lit(0.0), mean - z * std)).withColumn("p95", mean + z * std)


@query("""WITH b AS (SELECT p_partkey AS part, 20 + ('0x' || left(md5(p_partkey::VARCHAR), 4))::BIGINT % 100 AS level, p_size / 100.0::DOUBLE AS vol FROM part), w AS (SELECT *, unnest(range(1, 9)) AS week FROM b)
SELECT part, week::INT AS week, round(level * (1 + 0.01::DOUBLE * week), 3) AS mean, round(greatest(0, level * (1 + 0.01::DOUBLE * week) - 1.645::DOUBLE * level * vol * sqrt(1 + 0.05::DOUBLE * week)), 3) AS p05, round(level * (1 + 0.01::DOUBLE * week) + 1.645::DOUBLE * level * vol * sqrt(1 + 0.05::DOUBLE * week), 3) AS p95 FROM w""")
def stub_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deterministic levels from a digest of the key."""
    level = (20 + F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 4), 16, 10).cast("long") % 100).alias("level")
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), level, (F.col("p_size") / 100.0).alias("volatility"), F.lit(0.01).alias("trend"))
    return demand_bands(base).select("part", "week", *(F.round(c, 3).alias(c) for c in ("mean", "p05", "p95")))


def cash_limited(items: DataFrame, service: float = 0.95) -> DataFrame:
    """The quantity for a service level as far as the budget goes, and the service level that it reaches."""
    ideal = whole(F.col("p95")) if service >= 0.9 else whole(F.col("p50") + min(1.0, max(0.0, (service - 0.5) / 0.4)) * (F.col("p95") - F.col("p50")))
    most = F.when(F.col("price") > 0, F.floor(F.col("budget") / F.col("price"))).otherwise(0)
    q = F.least(ideal, most)
    between = lambda at, low, high: at + 0.45 * (F.col("quantity") - low) / F.greatest(F.lit(1.0), high - low)
    out = items.withColumn("quantity", q.cast("long")).withColumn("most", most.cast("long"))
    level = F.when(F.col("quantity") >= F.col("p95"), 0.95).when(F.col("quantity") >= F.col("p50"), between(0.5, F.col("p50"), F.col("p95"))).when(F.col("quantity") >= F.col("p5"), between(0.05, F.col("p5"), F.col("p50"))).otherwise(0.05)
    return out.withColumn("service", F.round(level, 4)).withColumn("quantity_p5", F.least(whole(F.col("p5")), F.col("quantity"))).withColumn("quantity_p95", F.least(F.greatest(F.col("quantity"), whole(F.col("p95"))), F.col("most"))).drop("most")


@query("""WITH f AS (SELECT l_partkey AS part, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.95) AS p95, floor(avg(l_extendedprice / l_quantity)) AS price FROM lineitem GROUP BY 1), q AS (SELECT *, least(round_even(p95, 0), floor(45000 / price))::BIGINT AS quantity, floor(45000 / price)::BIGINT AS most FROM f)
SELECT part, quantity, round(CASE WHEN quantity >= p95 THEN 0.95 WHEN quantity >= p50 THEN 0.5 + 0.45 * (quantity - p50) / greatest(1, p95 - p50) WHEN quantity >= p5 THEN 0.05 + 0.45 * (quantity - p5) / greatest(1, p50 - p5) ELSE 0.05 END, 4)::DOUBLE AS service, least(greatest(quantity, round_even(p95, 0)::BIGINT), most) AS quantity_p95 FROM q""")
def cash_limited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O16, A25."""
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    f = w.groupBy("part").agg(*(F.percentile("q", p, F.col("n")).alias(n) for n, p in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))), F.floor(F.sum("p") / F.sum("n")).alias("price")).withColumn("budget", F.lit(45000.0))
    return cash_limited(f).select("part", "quantity", "service", "quantity_p95")


def perturbed(forecasts: DataFrame, everywhere: float, by_sku: dict[str, float], key: str) -> DataFrame:
    """Demand times a factor; the spread shrinks to half at most."""
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in by_sku.items() for x in kv)), F.col(key).cast("string")), F.lit(1.0)) if by_sku else F.lit(1.0)
    factor = F.lit(everywhere) * own
    out = forecasts.withColumns({c: F.greatest(F.lit(0.0), F.col(c) * factor) for c in ("mean", "p05", "p50", "p95") if c in forecasts.columns})
    return out.withColumn("std", F.greatest(F.lit(0.01), F.col("std") * F.greatest(F.lit(0.5), factor)))


@query("""SELECT l_partkey AS part, round(greatest(0, avg(l_quantity) * 0.4 * CASE l_partkey WHEN 5 THEN 2 ELSE 1 END), 4) AS mean, round(greatest(0.01, stddev_pop(l_quantity) * greatest(0.5, 0.4 * CASE l_partkey WHEN 5 THEN 2 ELSE 1 END)), 4)::DOUBLE AS std FROM lineitem GROUP BY 1""")
def perturbed_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10, O19."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"))
    return perturbed(f, 0.4, {"5": 2.0}, "part").select("part", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def correlation(x: str, y: str) -> Column:
    """Of two columns, as an aggregate; null if one has no variance, where corr() fails."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def nearest_psd(matrix: np.ndarray) -> np.ndarray:
    """M9: eigenvalues lifted to a small positive number, then unit diagonal again."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    lifted = (vectors * np.maximum(values, 1e-8)) @ vectors.T
    scale = np.sqrt(np.diag(lifted))
    return np.clip(lifted / np.outer(scale, scale), -1, 1)


def correlated_demand(spark: SparkSession, names: list[str], mean: np.ndarray, std: np.ndarray, correlation: np.ndarray, n_sims: int, seed: int = 42) -> DataFrame:
    """M7: (sim, name, demand) of normals with the given correlation (a small matrix, checked by its callers), clipped at 0."""
    factor = np.linalg.cholesky(nearest_psd(correlation) + 1e-9 * np.eye(len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            draws = np.stack([np.random.default_rng((seed, int(s))).standard_normal(len(names)) for s in pdf["id"]]) if len(pdf) else np.zeros((0, len(names)))
            demand = np.maximum(0, mean + std * (draws @ factor.T))
            yield pd.DataFrame({"sim": np.repeat(pdf["id"].to_numpy(), len(names)), "name": names * len(pdf), "demand": demand.ravel()})

    return spark.range(n_sims).mapInPandas(run, "sim long, name string, demand double")


@query(f"""WITH w AS (SELECT p_type AS category, isoyear(l_shipdate) * 100 + week(l_shipdate) AS k, sum(l_quantity) AS units FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT a.category AS a, b.category AS b, round(corr(a.units, b.units), 4) + 0 AS correlation FROM w a JOIN w b ON a.k = b.k AND a.category < b.category GROUP BY 1, 2""")
def category_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: correlations of the categories' weekly units, over the weeks both sold."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("category"))
    w = weekly(spark, sf_dir).join(part, "part").groupBy("category", (F.col("year") * 100 + F.col("week")).alias("k")).agg(F.sum("units").alias("units"))
    a, b = w.select(F.col("category").alias("a"), "k", F.col("units").alias("x")), w.select(F.col("category").alias("b"), "k", F.col("units").alias("y"))
    return a.join(b, "k").where("a < b").groupBy("a", "b").agg((F.round(correlation("x", "y"), 4) + F.lit(0.0)).alias("correlation"))


@query("""SELECT a.s_suppkey AS supplier, b.s_suppkey AS other, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS place FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey QUALIFY place <= 3""")
def nearest_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three suppliers of a supplier's nation with the nearest balance, of equally near ones the smallest keys.

    They are among the four smallest keys of its own balance and the three of
    each of the three balances on either side, so a window over the balances
    gives them and no pairs are formed.  Unknown balances come last; to a
    supplier without one all others are equally near.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")).where("nation is not null")

    def smallest(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        kept = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("supplier"))).where("place <= 4")
        return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("supplier")).alias(name))

    known = smallest(s.where("balance is not null"), ["nation", "balance"], "same")
    w = Window.partitionBy("nation").orderBy("balance")
    sides = [F.struct(f("balance", k).over(w).alias("balance"), f("same", k).over(w).alias("others")) for f in (F.lag, F.lead) for k in (1, 2, 3)]
    known = known.select("nation", "balance", F.array(F.struct("balance", F.col("same").alias("others")), *sides).alias("near"))
    no_balance = smallest(s.where("balance is null"), ["nation"], "unknown")
    some = s.where("balance is not null").join(known, ["nation", "balance"]).join(F.broadcast(no_balance), "nation", "left")
    some = some.select("supplier", "balance", F.explode(F.array_append("near", F.struct(F.lit(None).cast("double").alias("balance"), F.col("unknown").alias("others")))).alias("n"))
    none = s.where("balance is null").join(F.broadcast(smallest(s, ["nation"], "others")), "nation")
    none = none.select("supplier", "balance", F.struct(F.lit(None).cast("double").alias("balance"), "others").alias("n"))
    rows = some.unionByName(none).select("supplier", F.abs(F.col("balance") - F.col("n.balance")).alias("apart"), F.explode("n.others").alias("other")).where("other <> supplier")
    place = F.row_number().over(Window.partitionBy("supplier").orderBy(F.asc_nulls_last("apart"), "other"))
    return rows.select("supplier", "other", place.alias("place")).where("place <= 3")


def similar_rows(rows: DataFrame, k: int = 3) -> DataFrame:
    """(id, other, place) of the k most similar others of each row: of the same region first, then by difference of reliability, of reputation, and by id.

    rows: id, region, reliability, reputation; none is null.  Classes of equal
    reliability are ranked; a row looks into its own and k classes on either
    side, and meets there the k nearest reputations on either side, found by
    counts in their order, so that no pairs are formed.  Rows of regions with
    k others or fewer look into all regions too.
    """

    def near(asked: DataFrame, scope: Column, k: int) -> DataFrame:
        held, asked = rows.withColumn("scope", scope), asked.withColumn("scope", scope)
        ranks = held.select("scope", "reliability").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy("reliability")))
        keys = ["scope", "rank"]
        ranked = held.join(ranks, ["scope", "reliability"])
        probes = asked.join(ranks, ["scope", "reliability"]).withColumn("own", F.col("rank")).withColumn("rank", F.explode(F.sequence(F.col("own") - k, F.col("own") + k))).select(*keys, "id", "region", "reliability", "reputation", F.lit(1).alias("side"))
        order = Window.partitionBy(*keys).orderBy("reputation", "side").rowsBetween(Window.unboundedPreceding, 0)
        swept = ranked.select(*keys, "id", "region", "reliability", "reputation", F.lit(0).alias("side")).unionByName(probes).withColumn("seen", F.sum(1 - F.col("side")).over(order)).where("side = 1")
        # Of equal reputations the smaller ids count as nearer, on both sides.
        within = Window.partitionBy(*keys)
        found = ranked.select(*keys, F.col("id").alias("other"), F.col("region").alias("o_region"), F.col("reliability").alias("o_rel"), F.col("reputation").alias("o_rep"), F.row_number().over(within.orderBy("reputation", F.desc("id"))).alias("down"), F.row_number().over(within.orderBy("reputation", "id")).alias("up"))
        left = swept.withColumn("down", F.explode(F.sequence(F.col("seen") - k, F.col("seen")))).join(found.drop("up"), [*keys, "down"])
        right = swept.withColumn("up", F.explode(F.sequence(F.col("seen") + 1, F.col("seen") + k))).join(found.drop("down"), [*keys, "up"])
        pick = ("id", "region", "reliability", "reputation", "other", "o_region", "o_rel", "o_rep")
        return left.select(*pick).unionByName(right.select(*pick)).where("id <> other")

    small = rows.join(rows.groupBy("region").count().where(F.col("count") <= k).select("region"), "region", "left_semi")
    both = near(rows, F.col("region"), k).unionByName(near(small, F.lit(0), 2 * k)).dropDuplicates(["id", "other"])
    order = (F.col("region") != F.col("o_region"), F.abs(F.col("reliability") - F.col("o_rel")), F.abs(F.col("reputation") - F.col("o_rep")), F.col("other"))
    return both.select("id", "other", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("place")).where(F.col("place") <= k)


@query("""WITH s AS (SELECT s_suppkey AS id, n_regionkey AS region, s_suppkey % 10 / 10.0::DOUBLE AS rel, s_acctbal AS rep FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT a.id AS supplier, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY a.region <> b.region, abs(a.rel - b.rel), abs(a.rep - b.rep), b.id) AS place FROM s a JOIN s b ON a.id <> b.id QUALIFY place <= 3""")
def similar_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reliability is a stand-in, the reputation the balance."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    rows = s.select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("region"), (F.col("s_suppkey") % 10 / 10.0).alias("reliability"), F.col("s_acctbal").alias("reputation"))
    return similar_rows(rows).select(F.col("id").alias("supplier"), "other", "place")


def provenance(decided: DataFrame, key: str) -> DataFrame:
    """Decisions as (s, p, o) triples; arrays fan out, nulls are left out."""
    said = F.array(F.struct(F.lit("type").alias("p"), F.lit("Decision").alias("o")), F.struct(F.lit("rule").alias("p"), F.col("rule").alias("o")), F.struct(F.lit("confidence").alias("p"), F.col("confidence").cast("string").alias("o")))
    stages = F.transform(F.coalesce("stages", F.array().cast("array<string>")), lambda x: F.struct(F.lit("stage").alias("p"), x.alias("o")))
    return decided.select(F.concat(F.lit("decision/"), F.col(key)).alias("s"), F.explode(F.concat(said, stages)).alias("t")).where("t.o is not null").select("s", "t.p", "t.o")


def read_back(triples: DataFrame) -> DataFrame:
    """Decisions from triples, stages sorted."""
    one = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    return triples.groupBy("s").agg(one("rule").alias("rule"), one("confidence").cast("double").alias("confidence"), F.sort_array(F.collect_list(F.when(F.col("p") == "stage", F.col("o")))).alias("stages"))


@query("""SELECT 'decision/' || p_partkey AS s, CASE WHEN p_size % 17 = 0 THEN 0 WHEN p_partkey % 3 = 1 AND p_size % 13 / 13.0 >= 0.7 THEN 6 ELSE 5 END AS n_stages FROM part""")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as triples and read back."""
    back = read_back(provenance(dispatch(contexts(spark, sf_dir), blocked=F.col("stopped")), "part"))
    return back.select("s", F.size("stages").alias("n_stages"))


@query("""SELECT p_partkey AS part FROM part WHERE p_partkey % 3 = 0 AND p_size * 2 >= 52 AND p_size % 17 <> 0 AND ((p_size % 10 / 10.0 < 0.3) <> (p_size % 10 / 10.0 + 0.2 < 0.3)) AND p_size % 9 <> 0
UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_size * 2 >= 52 AND p_size % 17 <> 0 AND p_size % 9 = 0 AND p_size % 10 / 10.0 < 0.3 AND p_size % 10 / 10.0 + 0.2 >= 0.3""")
def replayed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions whose stages change when volatility grows by 0.2."""
    now = contexts(spark, sf_dir)
    before = dispatch(now, blocked=F.col("stopped")).select("part", F.col("stages").alias("a"))
    after = dispatch(now.withColumn("volatilidad_forecast", F.col("volatilidad_forecast") + 0.2), blocked=F.col("stopped")).select("part", F.col("stages").alias("b"))
    diff = before.join(after, "part").withColumn("d", stage_changes(F.col("a"), F.col("b")))
    return diff.where("size(d.added) + size(d.removed) > 0").select("part")


def explain(name: Column, quantity: Column, text: Column | None = None) -> Column:
    """The prose of a decision without a language model."""
    return F.format_string("Se recomienda comprar %d unidades de %s.", quantity.cast("long"), name)


def invented_numbers(prompt: Column, answer: Column) -> Column:
    """Numbers of an answer that its prompt does not have."""
    from ..functions.text import numbers

    return F.array_except(numbers(answer), numbers(prompt))


def cited(answer: Column, sources: list[str]) -> Column:
    """The sources that an answer names."""
    return F.filter(F.array(*(F.lit(s) for s in sources)), lambda s: F.contains(answer, s))


def dataset_hash(df: DataFrame) -> DataFrame:
    """A digest of all rows, whatever their order: the sums of parts of the rows' digests, hashed."""
    row = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    part = lambda k: F.sum(F.conv(F.substring("h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return row.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(part(k) for k in range(4))), 256).alias("digest"))


def embed(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """Unit vectors of hashed character trigrams (a pretrained encoder can take this place)."""
    import zlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = []
            for text in pdf["text"].fillna(""):
                v, low = np.zeros(dim), f" {text.lower()} "
                for k in range(len(low) - 2):
                    h = zlib.crc32(low[k : k + 3].encode())
                    v[h % dim] += 1 if h & (1 << 20) else -1
                vectors.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
            yield pd.DataFrame({id_col: pdf["id"], "embedding": vectors})

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
