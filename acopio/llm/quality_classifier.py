"""Supervised quality classifier with subword embeddings (list item 5).

Every word, pair of words and character n-gram of a document (case kept, a word's
edges marked by the blank beside it) is hashed to one of ``buckets`` learned
vectors; a document is the average of its vectors; a softmax over the classes
follows.  Vectors and output weights are trained together by stochastic
gradient descent in numpy.

Training reads at most ``max_rows`` labelled documents, those with the
smallest hashes of their ids: a documented bound, the same at every size of
the corpus.  Scoring reads every whole text where it lies.  As the output is
linear in the average, each bucket is folded to one number before scoring, so
the model that is sent out has ``buckets`` floats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import Chunk, chunks, code_points, edge_grams, mix, padded

BUCKETS, DIM, MAX_ROWS, VISITS = 1 << 18, 8, 4000, 24_000
SIZES = (2, 3, 4)
_BLANK = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _features(c: Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of each feature, one sort of feature at a time."""
    mask = np.uint64(buckets - 1)
    starts, ends, docs = c.words()
    words = c.hashes(starts, ends)
    yield docs, (words & mask).astype(np.int64)
    # Word pairs; a pair is known by the difference of its hashes, so that a word that follows itself is one feature, whichever word it is.
    pair = np.flatnonzero(docs[1:] == docs[:-1])
    yield docs[pair], (mix(words[pair + 1] - words[pair]) & mask).astype(np.int64)
    points, bounds = code_points(c)
    text, own = padded(np.where(np.isin(points, _BLANK), 32, points), bounds, 32)
    for size in SIZES:
        of, h = edge_grams(text, own, 32, size)
        yield of, (h & mask).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8, rate: float = 0.6, seed: int = 17) -> tuple[np.ndarray, float]:
    """SGD over (buckets, shares, label) rows; the folded weight of each bucket, and the bias."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            at, share, label = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= step * np.outer(p, hidden)
            bias -= step * 0.1 * p
            # Shares are small: each vector moves as if the document were one feature.
            vectors[at] -= step * len(at) ** 0.5 * np.outer(share, back)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, visits: int = VISITS, buckets: int = BUCKETS, dim: int = DIM) -> tuple[np.ndarray, float]:
    """Train on at most max_rows labelled documents for which learn (on labels) holds.

    Documents are visited about visits times in all, each four times at least
    and forty times at most, so that few labels are learned as well as many.
    Null ids and labels other than 0 and 1 are left out, as are texts without
    features; of rows that repeat each counts.  Without rows the model is the
    untrained one.
    """
    sample = (
        labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "label").limit(max_rows)
    )
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                found = list(_features(c, buckets))
                of, at = np.concatenate([d for d, _ in found]), np.concatenate([b for _, b in found])
                keys, counts = np.unique(of * buckets + at, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(c.n + 1) * buckets)
                rows = [(keys[a:b] % buckets, counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.first, c.n), batch.column(1).slice(c.first, c.n), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<i4").tobytes() for r in rows], pa.binary())],
                    names=["id", "label", "at", "n"],
                )

    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    rows = []
    for r in sorted(picked.mapInArrow(run, schema).collect(), key=lambda r: (r["id"], r["label"], bytes(r["at"]))):  # at most max_rows documents
        counts = np.frombuffer(r["n"], "<i4").astype(np.float32)
        if len(counts):
            rows.append((np.frombuffer(r["at"], "<i4"), counts / counts.sum(), r["label"]))
    return train(rows, buckets, dim, epochs=max(4, min(40, visits // max(1, len(rows)))))


def classify(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (probability of label 1) and predicted of every whole text.

    Null and empty texts have no features and get the score of the bias
    alone.  Null ids are kept; rows that repeat score alike; a score of 0.5 is
    1; long texts are read whole; an empty table gives an empty one; other
    columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            scores = []
            for c in chunks(batch.column(1)):
                total, n = np.zeros(c.n), np.zeros(c.n, np.int64)
                for of, at in _features(c, len(weights)):
                    total += np.bincount(of, weights[at], minlength=c.n)
                    n += np.bincount(of, minlength=c.n)
                scores.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(col: str, n: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted")
