"""Similarity of sparse vectors: an exact join above a threshold, by prefixes and norms (V3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..sources.readers import table
from ..sources.shared import written
from .catalog import purchases

SPLIT = 1 << 14  # entries of one feature that one task takes
BLOCK, ROWS, COLUMNS = 1 << 15, 1 << 11, 1 << 12  # vectors of a block, and the sides of a product in it
MEETINGS = 64  # meetings for each entry of a prefix up to which prefixes are joined


def unit(entries: DataFrame, round_to: int = 12) -> DataFrame:
    """(id, feature, x) with x divided by the length of its vector; vectors of length 0 have no entries."""
    held = entries.where("id is not null and feature is not null and x <> 0").groupBy("id", "feature").agg(F.sum("x").cast("double").alias("x"))
    size = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return held.withColumn("x", F.round(F.col("x") / size, round_to)).where("x <> 0")


def similar_above(entries: DataFrame, threshold: float, wanted: DataFrame | None = None) -> DataFrame:
    """(id, other, score) for all pairs with a cosine of at least threshold (over 0); of wanted ids only, if given.

    entries: id, feature, x of unit vectors with entries over 0.

    Features are put in order from the rarest.  What a vector has after its
    prefix is shorter than the threshold, so two vectors that are alike enough
    share a feature in the prefixes of both.  Candidates sum up what their
    prefixes share and go where this and the product of the rests cannot reach
    the threshold; the others are computed in full.  A feature with more
    entries than SPLIT on one side is dealt to several tasks.

    Where features are so few that most prefixes meet, all vectors are
    compared block by block instead: nothing is written for a pair that is
    not alike.
    """
    counts = entries.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("id").orderBy("n", "feature").rowsBetween(0, Window.unboundedFollowing)
    ranked = entries.join(counts, "feature").withColumn("rest", F.sqrt(F.sum(F.col("x") * F.col("x")).over(order)))
    # rest: the length from this entry on.  The first entry whose rest is below the threshold ends the prefix.
    after = F.sqrt(F.greatest(F.lit(0.0), F.col("rest") * F.col("rest") - F.col("x") * F.col("x")))
    prefix = written(ranked.where(F.col("rest") >= threshold - 1e-9).withColumn("after", after).select("id", "feature", "x", "after", "n"), "prefixes")
    asked = prefix if wanted is None else prefix.join(wanted.select("id").distinct(), "id", "left_semi")
    meet = asked.groupBy("feature").agg(F.count(F.lit(1)).alias("asked")).join(prefix.groupBy("feature").agg(F.count(F.lit(1)).alias("held")), "feature").agg(F.sum(F.col("asked").cast("double") * F.col("held")).alias("met"), F.sum("held").alias("held")).first()
    if meet["held"] and meet["met"] > MEETINGS * meet["held"]:
        return _alike_blocks(entries, threshold, wanted).select(F.col("a").alias("id"), F.col("b").alias("other"), F.round(F.least(F.lit(1.0), "dot"), 6).alias("score")).where(F.col("score") >= threshold)
    parts = (F.col("n") / SPLIT).cast("int")
    a = asked.select(F.col("id").alias("a"), "feature", F.col("x").alias("xa"), F.col("after").alias("ra"), F.explode(F.sequence(F.lit(0), parts)).alias("part"))
    b = prefix.select(F.col("id").alias("b"), "feature", F.col("x").alias("xb"), F.col("after").alias("rb"), F.when(parts > 0, F.pmod(F.xxhash64("id"), parts + 1)).otherwise(0).cast("int").alias("part"))
    met = a.join(b, ["feature", "part"]).where(F.col("a") < F.col("b") if wanted is None else F.col("a") != F.col("b"))
    # The rests after the last feature that the prefixes share bound what is left.
    pairs = met.groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("shared"), F.min("ra").alias("ra"), F.min("rb").alias("rb")).where(F.col("shared") + F.col("ra") * F.col("rb") >= threshold - 1e-9)
    return _above(entries, pairs, threshold)


def _above(entries: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose product, computed in full, reaches the threshold."""
    vectors = entries.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "x"))).alias("v"))
    both = pairs.select("a", "b").join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    return both.select(F.col("a").alias("id"), F.col("b").alias("other"), F.round(F.least(F.lit(1.0), dot), 6).alias("score")).where(F.col("score") >= threshold)


def _alike_blocks(entries: DataFrame, threshold: float, wanted: DataFrame | None) -> DataFrame:
    """(a, b, dot) for all pairs whose product in single precision is not clearly below the threshold.

    A vector goes once to each block of the other side.  Features are told
    apart by their hash of 64 bits; dot is computed in double precision.
    """
    held = F.collect_list(F.struct(F.xxhash64("feature").alias("f"), "x"))
    rows = entries.groupBy("id").agg(held.alias("v"))
    rows = rows.withColumn("asks", F.lit(True)) if wanted is None else rows.join(wanted.select("id", F.lit(True).alias("asks")).distinct(), "id", "left")
    rows = written(rows.select("id", F.transform("v", lambda e: e["f"]).alias("f"), F.transform("v", lambda e: e["x"]).alias("x"), F.coalesce("asks", F.lit(False)).alias("asks")), "vectors")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asked")).first()
    left, right = (max(1, -(-n[c] // BLOCK)) for c in ("asked", "all"))
    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    asking = rows.where("asks").select(place(left).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("j"), F.lit(True).alias("asks"), "id", "f", "x")
    others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("i"), place(right).alias("j"), F.lit(False).alias("asks"), "id", "f", "x")
    schema = T.StructType([T.StructField("a", entries.schema["id"].dataType), T.StructField("b", entries.schema["id"].dataType), T.StructField("dot", T.DoubleType())])

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        sizes = np.diff(np.concatenate(([0], np.cumsum([len(x) for x in block["f"]]))))
        features, code = np.unique(block["f"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        x, first = block["x"].combine_chunks().flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
        asks = block["asks"].to_numpy()

        def dense(of: np.ndarray, low: int, kind: type = np.float32) -> np.ndarray:
            at = np.concatenate([np.arange(first[r], first[r + 1]) for r in of])
            row, keep = np.repeat(np.arange(len(of)), sizes[of]), (code[at] >= low) & (code[at] < low + COLUMNS)
            out = np.zeros((len(of), min(COLUMNS, len(features) - low)), kind)
            np.add.at(out, (row[keep], code[at][keep] - low), x[at][keep])
            return out

        u, v = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[np.ndarray] = []
        dots: list[np.ndarray] = []
        for k in range(0, len(v), 2 * ROWS):
            them = v[k : k + 2 * ROWS]
            parts = {low: dense(them, low) for low in range(0, len(features), COLUMNS)} if len(features) <= COLUMNS else {}
            for h in range(0, len(u), ROWS):
                us = u[h : h + ROWS]
                alike = sum(dense(us, low) @ (parts[low] if parts else dense(them, low)).T for low in range(0, len(features), COLUMNS))
                a, b = np.nonzero(alike >= threshold - 1e-4)
                for at in range(0, len(a), ROWS):
                    one, two = us[a[at : at + ROWS]], them[b[at : at + ROWS]]
                    found.append(np.stack((one, two)))
                    dots.append(sum((dense(one, low, float) * dense(two, low, float)).sum(axis=1) for low in range(0, len(features), COLUMNS)))
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": block["id"].take(pa.array(a)), "b": block["id"].take(pa.array(b)), "dot": pa.array(np.concatenate([np.zeros(0), *dots]))})

    pairs = asking.unionByName(others).groupBy("i", "j").applyInArrow(run, schema)
    return pairs.where(F.col("a") < F.col("b") if wanted is None else F.col("a") != F.col("b"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (part), feature (month), x (units sold)."""
    return purchases(spark, sf_dir).groupBy(F.col("l_partkey").alias("id"), F.trunc("o_orderdate", "month").alias("feature")).agg(F.sum("l_quantity").alias("x"))


@query("""WITH m AS (SELECT l_partkey AS id, date_trunc('month', o_orderdate) AS f, sum(l_quantity)::DOUBLE AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), u AS (SELECT id, f, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 12) AS x FROM m WHERE x <> 0)
SELECT a.id, b.id AS other, round(least(1, sum(a.x * b.x)), 6) AS score FROM u a JOIN u b ON a.f = b.f AND a.id <> b.id WHERE a.id % 50 = 0 GROUP BY 1, 2 HAVING round(least(1, sum(a.x * b.x)), 6) >= 0.55""")
def behavioural_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: all parts whose monthly sales have a cosine of 0.55 or more with those of every fiftieth part."""
    entries = written(unit(monthly(spark, sf_dir)), "months")
    return similar_above(entries, 0.55, table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")))


def trend_score(vector, trend):
    """V4: the product of a product's unit vector and a trend's, 0 where one is missing, in [0, 1]."""
    dot = F.aggregate(F.zip_with(vector, trend, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(dot.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))


_TREND = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT label, k, avg(e[k]) AS m FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS k FROM v WHERE vec_id % 50 = 0) GROUP BY 1, 2), z AS (SELECT label, list(m / s ORDER BY k) AS t FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS s FROM c) GROUP BY 1)"""


@query(f"WITH {_TREND} SELECT vec_id, round(CASE WHEN t IS NULL OR v.label % 4 = 3 THEN 0 ELSE least(1, greatest(0, list_dot_product(e, t))) END, 5)::DOUBLE AS trend, CASE WHEN t IS NULL OR v.label % 4 = 3 THEN 'missing' ELSE 'available' END AS flag FROM v LEFT JOIN z ON z.label = v.label")
def trend_vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: each product against the vector of its category's trend (the mean of every fiftieth product's, made a unit vector); a category without a trend scores 0."""
    v = table(spark, sf_dir, "embeddings")
    means = v.where("vec_id % 50 = 0").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    trend = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda y: y["m"]).alias("t")).select("label", F.transform("t", lambda x: x / F.col("size")).alias("t"))
    joined = v.join(trend.where("label % 4 <> 3"), "label", "left")
    return joined.select("vec_id", F.round(trend_score(F.col("embedding"), F.col("t")), 5).alias("trend"), F.when(F.col("t").isNull(), "missing").otherwise("available").alias("flag"))
