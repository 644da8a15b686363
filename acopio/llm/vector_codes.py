"""Vector code compression (list item 13): product quantisation in whole numbers.

Components are scaled and floored to integers and a vector is cut into parts.
Equal parts of a position are one weighted row; weighted Lloyd rounds run over
these distinct rows, whose nearest entries are found in numpy and whose sums
are added up in map-side combined groups.  A codebook is a few thousand
integers.  The codes and errors of the distinct parts are joined back to the
vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 26  # a scaled component of a greater size counts as this
HEAVY = 1024  # parts that more than one vector in HEAVY has are dealt to SALTS tasks
SALTS = 256

Codebooks = list[np.ndarray]  # of each position: entries x width


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """Kept rows: a number for each, id, label and the integer components.

    The number is written with the rows, so it stays when a task runs again.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    number = lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    kept = vectors.where(good).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(v, number).alias("x"))
    return materialise(kept, "vectors")


def exploded(kept: DataFrame, parts: int) -> DataFrame:
    """Row number, and the bytes of each part behind the number of its position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(1).flatten()).astype("<i4").reshape(n, parts, -1)
            width = x.shape[2] * 4 + 1
            keys = np.empty((n, parts, width), np.uint8)
            keys[:, :, 0] = np.arange(parts)
            keys[:, :, 1:] = np.ascontiguousarray(x).view(np.uint8).reshape(n, parts, -1)
            rows = np.repeat(np.asarray(batch.column(0)), parts)
            ends = np.arange(0, (n * parts + 1) * width, width, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.Array.from_buffers(pa.binary(), n * parts, [None, pa.py_buffer(ends), pa.py_buffer(keys)])], names=["row", "part"])

    return kept.select("row", "x").mapInArrow(run, "row long, part binary")


def decoded(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Position and components of parts, all of one width."""
    raw = np.frombuffer(b"".join(parts.to_pylist()), np.uint8).reshape(len(parts), -1)
    return raw[:, 0].astype(np.int64), np.ascontiguousarray(raw[:, 1:]).view("<i4").astype(np.int64)


def nearest(position: np.ndarray, x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The lowest index among the nearest entries of each part, and its squared distance."""
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        for some in np.array_split(at, 1 + len(at) // 4096):
            far = np.zeros((len(some), len(books[p])), np.int64)
            for k in range(x.shape[1]):
                far += (x[some, k, None] - books[p][None, :, k]) ** 2
            code[some] = far.argmin(1)
            error[some] = far.min(1)
    return code, error


def assigned(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """distinct with code and error of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error = nearest(*decoded(batch.column(0)), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(np.int32)), pa.array(error)], names=["part", "n", "code", "error"])

    return distinct.select("part", "n").mapInArrow(run, "part binary, n long, code int, error long")


def moved(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry replaced by the floored weighted mean of its parts; unused entries stay.

    Each task sums its parts by entry, so that tasks x entries rows are
    shuffled, and one row of each entry comes back.
    """
    width, parts = books[0].shape[1], len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), width + 1), np.int64) for b in books]
        for batch in batches:
            if batch.num_rows:
                position, x = decoded(batch.column(0))
                n = np.asarray(batch.column(1))
                code, _ = nearest(position, x, books)
                for p in np.unique(position):
                    at = position == p
                    np.add.at(total[p], code[at], np.concatenate((x[at], np.ones((at.sum(), 1), np.int64)), axis=1) * n[at, None])
        p, c = (np.concatenate(y) for y in zip(*((np.full(len(b), k), np.arange(len(b))) for k, b in enumerate(books)), strict=True))
        flat = np.concatenate(total)
        used = flat[:, -1] > 0
        yield pa.RecordBatch.from_arrays([pa.array(p[used].astype(np.int32)), pa.array(c[used].astype(np.int32)), *(pa.array(flat[used, k].copy()) for k in range(width + 1))], names=["p", "c", *(f"s{k}" for k in range(width)), "n"])

    sums = distinct.select("part", "n").mapInArrow(run, f"p int, c int, {''.join(f's{k} long, ' for k in range(width))}n long")
    total = sums.groupBy("p", "c").agg(*(F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in total.collect():  # one row of each entry at most
        out[r["p"]][r["c"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    assert len(out) == parts
    return out


def fit(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, Codebooks]:
    """Weighted distinct parts (written to the shared folder), and the codebooks after the rounds."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = [start[:, p].copy() for p in range(parts)]
    distinct = materialise(exploded(kept, parts).groupBy("part").agg(F.count(F.lit(1)).alias("n")), "parts")
    for _ in range(rounds):
        books = moved(distinct, books)
    return distinct, books


def digest(books: Codebooks) -> str:
    """SHA-256 of the decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encoded(kept: DataFrame, distinct: DataFrame, books: Codebooks) -> DataFrame:
    """Row number, codes by position and summed error of each vector."""
    parts = len(books)
    coded = assigned(distinct, books)
    rows = kept.count()
    # Fewer than HEAVY parts of each position, whatever the number of vectors.
    heavy = [r["part"] for r in distinct.where(F.col("n") * HEAVY > rows).select("part").collect()]
    left, hot = exploded(kept, parts), F.col("part").isin([bytes(h) for h in heavy]) if heavy else F.lit(False)
    left = left.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    right = coded.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = left.join(right, ["part", "salt"]).select("row", (F.conv(F.hex(F.substring("part", 1, 1)), 16, 10).cast("int") * 65536 + F.col("code")).alias("at"), "error")
    sorted_ = met.groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("at"), F.sum("error").alias("error"))
    return sorted_.select("row", F.transform("at", lambda x: x % 65536).alias("codes"), "error")


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all vectors, and the codebooks they point into.

    The frame has id_col, label_col, codes (an entry for each position), error
    (squared distances summed over positions) and label_error (errors summed
    over equal labels, nulls together).

    A codebook starts as the parts of the vectors with the smallest ids, nulls
    last; of equal ids the smaller vector comes first.  Fewer vectors than
    entries give shorter codebooks.  Distances that tie go to the lower index.
    Means are floored.

    Dropped: null vectors, those with null or non-finite components, empty
    ones, those whose length is no multiple of parts, and those of another
    length than the vector with the smallest id.  Scaled components beyond
    2 ** 26 count as 2 ** 26, so that no sum of squares overflows.  Rows that repeat
    are each returned, with equal codes.  An empty table gives an empty frame
    and empty codebooks.  Other columns are not returned, so their names do not
    matter.  parts may be 128 at most and entries 65,536.
    """
    kept = whole_vectors(vectors, id_col, vector_col, label_col, parts, scale)
    length = kept.select(F.min_by(F.size("x"), F.struct(F.col("id").isNull(), "id", "x"))).first()[0]
    names = (F.col("id").alias(id_col), F.col("label").alias(label_col))
    if length is None:
        return kept.select(*names, F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    kept = kept.where(F.size("x") == length)
    distinct, books = fit(kept, parts, entries, rounds)
    done = materialise(kept.select("row", "id", "label").join(encoded(kept, distinct, books), "row"), "codes")
    sums = done.groupBy("label").agg(F.sum("error").alias("label_error"))
    return with_label_error(done, sums).select(*names, "codes", "error", "label_error"), books


def with_label_error(done: DataFrame, sums: DataFrame) -> DataFrame:
    """done with the sum of its label; labels that more than one row in HEAVY has are dealt to SALTS tasks."""
    counts = done.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = done.count()
    # Fewer than HEAVY labels.
    heavy = [r["label"] for r in counts.where(F.col("n") * HEAVY > total).select("label").collect()]
    known = [x for x in heavy if x is not None]
    hot = (F.col("label").isin(known) if known else F.lit(False)) | F.col("label").isNull()
    hot = F.coalesce(hot, F.lit(True))
    left = done.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    right = sums.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).withColumnRenamed("label", "of")
    return left.join(right.withColumnRenamed("salt", "dealt"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("dealt")), "left").drop("of", "salt", "dealt")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_NEAREST = "a{0} AS (SELECT p, y, n, min(far * 64 + c) AS best FROM (SELECT d.p, d.y, d.n, b.c, list_sum([(d.y[k] - b.e[k]) * (d.y[k] - b.e[k]) FOR k IN range(1, len(d.y) + 1)])::BIGINT AS far FROM d JOIN b{0} b ON d.p = b.p) GROUP BY p, y, n)"
_MOVED = """b{1} AS (
  SELECT p, c, list((s - ((s % m) + m) % m) // m ORDER BY k) AS e
  FROM (SELECT p, c, k, sum(n * y[k])::BIGINT AS s, sum(n)::BIGINT AS m FROM (SELECT p, best % 64 AS c, y, n, unnest(range(1, len(y) + 1)) AS k FROM a{0}) GROUP BY p, c, k) GROUP BY p, c
  UNION ALL SELECT p, c, e FROM b{0} WHERE (p, c) NOT IN (SELECT (p, best % 64) FROM a{0}))"""
OP13_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS x
  FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (
  SELECT r, p, x[p * w + 1:(p + 1) * w] AS y FROM (SELECT r, x, len(x) // 16 AS w, unnest(range(16)) AS p FROM v)
), d AS (
  SELECT p, y, count(*)::BIGINT AS n FROM parts GROUP BY p, y
), b0 AS (SELECT p, r - 1 AS c, y AS e FROM parts WHERE r <= 64),
{_NEAREST.format(0)}, {_MOVED.format(0, 1)}, {_NEAREST.format(1)}, {_MOVED.format(1, 2)}, {_NEAREST.format(2)},
hashed AS (
  SELECT sha256(string_agg(z::VARCHAR, ',' ORDER BY p, c, k)) AS codebooks_sha256 FROM (SELECT p, c, unnest(e) AS z, unnest(range(len(e))) AS k FROM b2)
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM parts JOIN a2 USING (p, y) GROUP BY r
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), hashed
"""
