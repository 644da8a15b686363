"""Line deduplication across documents (list item 3).

Lines are exploded with their position, keyed by a hash of the normalised
line, counted by distinct documents, dropped where too many documents share
them, and each document is put together again from the positions that stay.

Only hashes, ids and positions are shuffled for the counting; a text moves
once, in the join that reassembles it.  A key that a third of all rows share
is counted from per-task partial counts, and its lines are dealt to as many
salts as there are shuffle partitions for the join that finds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key128, table
from .words import Chunk, chunks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def keyed_lines(texts: pa.Array, min_chars: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Document, position and the two halves of a 128-bit hash of the keys of all lines with a key of min_chars code points."""
    for c in chunks(texts):
        low = Chunk(_LOWER[c.buf], c.bounds, c.first)
        starts, ends, of = low.lines()
        pos = np.arange(len(starts)) - np.searchsorted(of, np.arange(c.n))[of]
        word_starts, word_ends, _ = low.words()
        first, last = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends) - 1
        has = np.flatnonzero(last >= first)
        a, b = word_starts[first[has]], word_ends[last[has]]
        points = np.concatenate(([0], np.cumsum((low.buf & 0xC0) != 0x80)))
        long_ = points[b] - points[a] >= min_chars
        has, a, b = has[long_], a[long_], b[long_]
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(low.buf[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64).reshape(-1, 2)
        yield c.first + of[has], pos[has], keys[:, 0], keys[:, 1]


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop the lines that at least min_docs documents share.

    Returns the columns of docs with text_col rebuilt, and n_lines (before
    dropping) and n_dropped, which replace columns of these names.

    A line's key is the line without ASCII white space at both ends and with
    A-Z lowered; keys under min_chars code points are never dropped.  The
    largest id that holds a key keeps all its lines.

    Nulls: a null text is one empty line.  Rows with a null id count as one
    document, smaller than any other.  Rows that repeat an id are one document
    for the counts, and each is returned.  Ties cannot occur, since ids
    decide.  An empty table gives an empty table.  Other columns pass through,
    whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = key128(F.col(id_col), text)
    fields = [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("r1", "r2", "pos", "a", "b"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, pos, a, b in keyed_lines(batch.column(3), min_chars):
                at = pa.array(of)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(pos), pa.array(a), pa.array(b)], names=[f.name for f in fields])

    found = docs.select(F.col(id_col).alias("id"), row[0].alias("r1"), row[1].alias("r2"), text.alias("text")).mapInArrow(run, T.StructType(fields))
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    shared = (
        found.select("a", "b", "id", "salt").distinct()
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"), F.collect_set("salt").alias("salts"))
        .where(F.col("n") >= min_docs)
        # Each shared key once for each salt that its lines have, so that the lines of a hot key meet it in as many tasks as there are.
        .select("a", "b", "keeper", F.explode("salts").alias("salt"))
    )
    dropped = (
        found.join(shared, ["a", "b", "salt"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("r1", "r2").agg(F.collect_set(F.col("pos").cast("int")).alias("gone"))
    )
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    left = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), row[0].alias("r1"), row[1].alias("r2"))
    whole = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    parts = F.split(whole, "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    rebuilt = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.transform(stays, lambda i: F.get(F.col("parts"), i)), "\n"))
    return (
        left.join(dropped, ["r1", "r2"], "left")
        .withColumn("parts", F.when(F.col("gone").isNotNull(), parts))
        .select(
            *(F.col(f"row.`{c}`").alias(c) for c in others),
            rebuilt.alias(text_col),
            F.size(parts).cast("long").alias("n_lines"),
            F.coalesce(F.size(F.col("gone")), F.lit(0)).cast("long").alias("n_dropped"),
        )
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT l.doc_id, l.pos, l.line, s.k IS NOT NULL AND l.doc_id <> s.keeper AS gone
  FROM keyed l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
