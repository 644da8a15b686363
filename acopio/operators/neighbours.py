"""An inverted file over vectors: cells from a bounded sample, every row indexed, exact scores of what is probed (F2, V9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.readers import table
from .similarity import LEXICAL, SCORES, STRUCTURAL, top_k_edges

SAMPLE = 65_536  # vectors that the cells are fitted on, at most
CELLS = 1024  # cells, at most
PROBES = 32  # cells of its own attribute that a search reads, at most
NEAR = 2  # cells of all attributes that a search reads
PART = 4096  # vectors of a cell that one task scores
ASKED = 16_384  # searches of a cell that one task answers, about


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def sampled(vectors: DataFrame, vec_col: str, sample: int = SAMPLE) -> np.ndarray:
    """The vectors with the smallest hashes, sample at most, as columns and not as Row objects."""
    held = vectors.where(F.col(vec_col).isNotNull()).select(vec_col).orderBy(F.xxhash64(vec_col)).limit(sample).toArrow()
    return np.asarray(held.column(0).combine_chunks().flatten()).astype(float).reshape(held.num_rows, -1) if held.num_rows else np.zeros((0, 0))


def fit_cells(vectors: DataFrame, vec_col: str, count: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 7, held: np.ndarray | None = None) -> np.ndarray:
    """Unit centres of the cells (spherical k-means), from the sample with the smallest hashes of their vectors (held, if it was taken before).

    Of n vectors there are about sqrt(n) cells, CELLS at most.  The sample bounds
    what reaches the driver; every vector is indexed, whether sampled or not.
    """
    n = vectors.count()
    held = sampled(vectors, vec_col, sample) if held is None else held
    if not len(held):
        return np.zeros((0, 0))
    x = _unit(held)
    k = min(count or max(1, min(CELLS, round(n**0.5))), len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        used = np.linalg.norm(total, axis=1) > 0
        centres[used] = _unit(total[used])
    return centres


def with_cells(vectors: DataFrame, vec_col: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """vectors with cell, the nearest centre; with probes over 1 a row for each of so many nearest ones."""
    probes, at = min(probes, len(centres)), vectors.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(at).flatten()).astype(float).reshape(batch.num_rows, -1)
                cell = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array(cell.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

    fields = ", ".join(f"`{c}` {t}" for c, t in vectors.dtypes)
    return vectors.where(F.col(vec_col).isNotNull()).mapInArrow(run, f"{fields}, cell int")


def nearest(vectors: DataFrame, id_col: str, vec_col: str, attr_col: str, k: int = 1, wanted: DataFrame | None = None, probes: int = PROBES, near: int = NEAR, lexical_share: float = LEXICAL / (LEXICAL + STRUCTURAL)) -> DataFrame:
    """top_k_edges() by the index: (id, other, lexical, structural, score, place) of the k best others that the probed cells hold.

    An equal attribute is worth 0.6 of a cosine, so most of the best share it:
    each attribute has cells of its own (about sqrt(n) over all attributes), of
    which a search reads the nearest probes.  Others must be very near, so the
    nearest near of about sqrt(n) cells of all attributes hold them.

    A vector is written twice, into a cell of each kind, and a search goes to
    probes + near cells.  Cells with more than PART vectors are dealt to several
    tasks, and so are more than ASKED searches, so rows grow with vectors and searches, not with their product.
    """
    wanted = vectors if wanted is None else wanted
    schema = "id long, other long, lexical double, structural double, score double"
    plain = lambda df: df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(attr_col).cast("string").alias("a"))
    n, attributes = vectors.agg(F.count(F.lit(1)), F.approx_count_distinct(attr_col)).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], f"{schema}, place int")
    many = max(1, min(CELLS, round(n**0.5)))
    some = sampled(vectors, vec_col)
    kinds = ((fit_cells(vectors, vec_col, max(1, round(many / max(1, attributes))), held=some), probes, F.coalesce(F.concat(F.lit("="), F.col("a")), F.lit(""))), (fit_cells(vectors, vec_col, many, held=some), near, F.lit("*")))
    held = asked = None
    for centres, most, kind in kinds:
        if not len(centres):
            return vectors.sparkSession.createDataFrame([], f"{schema}, place int")
        one, two = (with_cells(plain(df), "v", centres, p).withColumn("cell", F.concat_ws("/", F.col("cell"), kind)) for df, p in ((vectors, 1), (wanted, most)))
        held, asked = (one, two) if held is None else (held.unionByName(one), asked.unionByName(two))
    parts = held.groupBy("cell").agg((F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row for each cell
    held = held.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts") + 1).cast("int"))
    # A cell that many ask is met by them in turns.
    turns = asked.groupBy("cell").agg((F.count(F.lit(1)) / ASKED).cast("int").alias("turns"))
    held = held.join(turns, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns"))))
    asked = asked.join(turns, "cell").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns") + 1).cast("int"))
    asked = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    w = lexical_share

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0].sort_values("id"), pdf[pdf["side"] == 1].sort_values("id")
        out = []
        for some in np.array_split(np.arange(len(x)), 1 + len(x) * len(y) // SCORES) if len(x) and len(y) else ():
            q = x.iloc[some]
            lexical = np.clip(np.stack(q["v"]).astype(float) @ np.stack(y["v"]).astype(float).T, 0, 1)
            equal = (q["a"].to_numpy()[:, None] == y["a"].to_numpy()[None, :]).astype(float)
            score = np.round(w * lexical + (1 - w) * equal, 9)
            score[q["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :]] = -1
            order = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row, at = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
            out.append(pd.DataFrame({"id": q["id"].to_numpy()[row], "other": y["id"].to_numpy()[at], "lexical": lexical[row, at], "structural": equal[row, at], "score": score[row, at]}))
        found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id", "other", "lexical", "structural", "score")})
        return found[found["score"] >= 0]

    met = asked.select("cell", "part", "turn", "id", "v", "a", F.lit(0).alias("side")).unionByName(held.select("cell", "part", "turn", "id", "v", "a", F.lit(1).alias("side")))
    found = met.groupBy("cell", "part", "turn").applyInPandas(best, schema).dropDuplicates(["id", "other"])
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def recall(found: DataFrame, truth: DataFrame, low: float = 0.0) -> DataFrame:
    """(n, found, recall): how many of truth's edges of low or more found has, a tie in score counting as found."""
    worst = found.groupBy("id").agg(F.min("score").alias("worst"), F.collect_set("other").alias("others"))
    hit = F.array_contains("others", F.col("other")) | (F.col("worst") >= F.col("score"))
    return truth.where(F.col("score") >= low).join(worst, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("found")).withColumn("recall", F.round(F.col("found") / F.col("n"), 6))


@query()
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, V9: the ten best others of every vector by the index, each asked for.  Rows only; recall in the tests and in index_recall."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", k=10).select("id", "other", F.round("score", 4).alias("score"), "place")


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: what the index finds of the best donors (score 0.6 or more) and of the ten best others, asked by every fiftieth vector, against all in blocks."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    out = None
    found, truth = (find(vectors, "vec_id", "embedding", "label", k=10, wanted=asked) for find in (nearest, top_k_edges))
    for k, low in ((1, 0.6), (10, 0.0)):
        one = recall(found.where(F.col("place") <= k), truth.where(F.col("place") <= k), low).select(F.lit(k).alias("k"), F.lit(low).alias("low"), "n", "found", "recall")
        out = one if out is None else out.unionByName(one)
    return out
