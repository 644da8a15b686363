"""Similarity of vectors and attributes: block products, renormalised scores, top-k edges and searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.readers import table

LEXICAL, STRUCTURAL = 0.5, 0.3
BLOCK = 2048
SCORES = 1 << 20  # scores that a task holds at once


def dot(a: Column, b: Column) -> Column:
    """V1: the product of two vectors in double precision, clipped to [0, 1]."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def gower(pairs: list[tuple[Column, Column, float]]) -> Column:
    """V2, V7: weighted equality over the attributes that both sides have; 0 if there are none."""
    held = [(a.isNotNull() & b.isNotNull() & (a != "") & (b != ""), a == b, w) for a, b, w in pairs]
    over = sum((F.when(ok, w).otherwise(0.0) for ok, _, w in held), F.lit(0.0))
    same = sum((F.when(ok & eq, w).otherwise(0.0) for ok, eq, w in held), F.lit(0.0))
    return F.when(over == 0, 0.0).otherwise(same / over)


def composite(scores: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """V5: the score over the signals that are there, weights renormalised, and the confidence (their weights)."""
    there = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in scores.items()), F.lit(0.0))
    total = sum((F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in scores.items()), F.lit(0.0))
    return F.when(there == 0, 0.0).otherwise(total / there), there


def top_k_edges(vectors: DataFrame, id_col: str, vec_col: str, attr_col: str, k: int = 10, block: int = BLOCK, wanted: DataFrame | None = None, lexical_share: float = LEXICAL / (LEXICAL + STRUCTURAL), bonus: float | None = None) -> DataFrame:
    """For each vector its k best others by 0.625 cosine + 0.375 equal attribute, or by cosine and a bonus for an equal one (1 at most).

    wanted, some of the vectors, restricts the rows that are searched for,
    not what is searched.  Rows are dealt into blocks of about block vectors; each task multiplies
    one block with one other and keeps k of each row, so a task holds two
    blocks and n * k * blocks rows leave the tasks, not n * n.
    """
    wanted = vectors if wanted is None else wanted
    blocks = max(1, -(-vectors.count() // block))
    wanted_blocks = max(1, -(-wanted.count() // block))
    deal = lambda df, m: df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(attr_col).cast("string").alias("a"), F.pmod(F.xxhash64(id_col), F.lit(m)).cast("int").alias("b"))
    other = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("o")
    left = deal(wanted, wanted_blocks).select("*", other(blocks)).select("id", "v", "a", F.lit(0).alias("side"), F.col("b").alias("p"), F.col("o").alias("q"))
    right = deal(vectors, blocks).select("*", other(wanted_blocks)).select("id", "v", "a", F.lit(1).alias("side"), F.col("o").alias("p"), F.col("b").alias("q"))
    w = lexical_share

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0].sort_values("id"), pdf[pdf["side"] == 1].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "lexical": [], "structural": [], "score": []})
        b, out = np.stack(y["v"]).astype(float), []
        for some in np.array_split(np.arange(len(x)), 1 + len(x) * len(y) // SCORES):
            q = x.iloc[some]
            lexical = np.clip(np.stack(q["v"]).astype(float) @ b.T, 0, 1)
            equal = (q["a"].to_numpy()[:, None] == y["a"].to_numpy()[None, :]).astype(float)
            score = np.round(w * lexical + (1 - w) * equal if bonus is None else np.clip(lexical + bonus * equal, 0, 1), 9)
            score[q["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = -1
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row, at = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
            out.append(pd.DataFrame({"id": q["id"].to_numpy()[row], "other": y["id"].to_numpy()[at], "lexical": lexical[row, at], "structural": equal[row, at], "score": score[row, at]}))
        found = pd.concat(out)
        return found[found["score"] >= 0]

    found = left.unionByName(right).groupBy("p", "q").applyInPandas(best, "id long, other long, lexical double, structural double, score double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair."""
    return edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "lexical", "structural", "score").dropDuplicates(["a", "b"])


_EDGES = """pairs AS (SELECT a.vec_id AS id, b.vec_id AS other, least(1, greatest(0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS lexical, (a.label = b.label)::INT::DOUBLE AS structural FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
scored AS (SELECT *, round(0.625 * lexical + 0.375 * structural, 9) AS score FROM pairs), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM scored), edges AS (SELECT * FROM ranked WHERE place <= 10)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of every vector whose id is divisible by 50, searched for among all; top_k_edges() itself takes any rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k_edges(vectors, "vec_id", "embedding", "label", wanted=vectors.where("vec_id % 50 = 0"))


@query(f"WITH {_EDGES} SELECT id, other, round(score, 4) AS score, place FROM edges")
def similar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6-V9, V14, W3, J16, X36."""
    return edges(spark, sf_dir).select("id", "other", F.round("score", 4).alias("score"), "place")


@query(f"WITH {_EDGES} SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(score, 4) AS score FROM edges")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge for each pair."""
    return undirected(edges(spark, sf_dir)).select("a", "b", F.round("score", 4).alias("score"))


@query(f"WITH {_EDGES}, u AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, round(score, 6) AS score FROM edges) SELECT count(*) AS n, round(min(score), 4) AS low, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.75), 4) AS p75, round(quantile_cont(score, 0.95), 4) AS p95, round(max(score), 4) AS high, round(avg(score), 4) AS mean FROM u")
def edge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores have six decimals, so that they are counted by value (a million values at most) before they are ranked."""
    p = lambda q: F.round(F.percentile("s", q, F.col("m")), 4)
    counts = undirected(edges(spark, sf_dir)).groupBy(F.round("score", 6).alias("s")).agg(F.count(F.lit(1)).alias("m"))
    return counts.agg(F.sum("m").alias("n"), F.round(F.min("s"), 4).alias("low"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.round(F.max("s"), 4).alias("high"), F.round(F.sum(F.col("s") * F.col("m")) / F.sum("m"), 4).alias("mean"))


def search(vectors: DataFrame, id_col: str, vec_col: str, wanted: list[float], k: int = 10) -> DataFrame:
    """The k vectors nearest to one, filtered before ranking."""
    score = F.round(dot(F.col(vec_col), F.array(*(F.lit(float(x)) for x in wanted))), 9)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


@query("""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(least(1, greatest(0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT id, other, round(score, 4) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM s QUALIFY place <= 10""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search, every vector whose id is divisible by 50 against all by cosine alone."""
    vectors = table(spark, sf_dir, "embeddings")
    found = top_k_edges(vectors, "vec_id", "embedding", "label", wanted=vectors.where("vec_id % 50 = 0"), lexical_share=1.0)
    return found.select("id", "other", F.round("score", 4).alias("score"), "place")


@query("""WITH c AS (SELECT p_brand AS brand, p_type AS type, p_size AS size, count(*) AS n FROM part GROUP BY 1, 2, 3), p AS (SELECT a.brand, a.type AS a_type, a.size AS a_size, b.type AS b_type, b.size AS b_size,
CASE WHEN a.type = b.type AND a.size = b.size THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs, (CASE WHEN a.type = b.type THEN 1.5 ELSE 0 END + CASE WHEN a.size = b.size THEN 0.5 ELSE 0 END + 1.0) / 3.0 AS s
FROM c a JOIN c b ON a.brand = b.brand AND (a.type, a.size) <= (b.type, b.size))
SELECT brand, a_type, a_size, b_type, b_size, n_pairs::BIGINT AS n_pairs, round(s, 4)::DOUBLE AS structural, round(0.3 * s / 0.3, 4)::DOUBLE AS score, 0.3::DOUBLE AS confidence FROM p WHERE n_pairs > 0""")
def structural_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute similarity of all parts of a brand; without other signals the weight is renormalised.

    Parts with the same attributes are one class.  Pairs of classes, with how
    many pairs of parts they stand for, grow with the attributes' domains and
    not with the parts.
    """
    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (part.select("brand", *(F.col(c).alias(f"{x}_{c}") for c in ("type", "size", "n"))) for x in "ab")
    first, second = F.struct("a_type", "a_size"), F.struct("b_type", "b_size")
    pairs = a.join(b, "brand").where(first <= second).withColumn("n_pairs", F.when(first == second, F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))).where("n_pairs > 0")
    s = gower([(F.col("a_type"), F.col("b_type"), 1.5), (F.col("a_size").cast("string"), F.col("b_size").cast("string"), 0.5), (F.col("brand"), F.col("brand"), 1.0)])
    score, sure = composite({"lexical": F.lit(None).cast("double"), "structural": F.col("s")}, {"lexical": LEXICAL, "structural": STRUCTURAL})
    return pairs.withColumn("s", s).select("brand", "a_type", "a_size", "b_type", "b_size", "n_pairs", F.round("s", 4).alias("structural"), F.round(score, 4).alias("score"), sure.alias("confidence"))


@query(f"WITH {_EDGES}, e AS (SELECT id, other, round(score, 6) AS score FROM edges WHERE round(score, 6) >= 0.5), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS place FROM e) SELECT id, other, p_name AS name, round(score, 4) AS score, place FROM r LEFT JOIN part ON other = p_partkey WHERE place <= 5")
def similar_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best edges of each product over a threshold, with names."""
    found = edges(spark, sf_dir).select("id", "other", F.round("score", 6).alias("score")).where("score >= 0.5")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    return found.withColumn("place", place).where("place <= 5").join(names, "other", "left").select("id", "other", "name", F.round("score", 4).alias("score"), "place")
