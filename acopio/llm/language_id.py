"""Language identification with bit-sliced Bloom filters (list item 8).

A slot of the filter holds one bit for each language.  A character n-gram
sets its language's bit in a few slots, so one lookup (the slots ANDed)
returns all languages that contain the n-gram.  A document's n-grams are
looked up, each language's hits are counted and corrected for the share that
false positives give at this filling, and the largest corrected count decides.

The filter learns from at most ``per_language`` documents of a language, those
with the smallest hashes of their ids; a language contains an n-gram if
enough of them do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .words import Chunk, chunks, code_points, edge_grams, mix, padded

SIZES, HASHES, PER_LANGUAGE = (3, 4), 3, 1000
_LAST = 0x3FFFF  # no plane above has letters
_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(k).isalpha() for k in range(_LAST + 1)]))
    return _letters[0][np.minimum(points, _LAST)]


def _ngrams(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and hash of each n-gram of letters (edges of words marked), and the letters of each document."""
    points, bounds = code_points(c)
    letter = _is_letter(points)
    total = np.concatenate(([0], np.cumsum(letter)))
    text, own = padded(np.where(letter, points, 0), bounds, 0)
    found = [edge_grams(text, own, 0, size) for size in SIZES]
    return np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found]), total[bounds[1:]] - total[bounds[:-1]]


class Filter:
    """languages: bit k of a slot is languages[k]; up to 64 a slice, further ones in further slices."""

    def __init__(self, languages: list[str], hashes: np.ndarray, masks: list[np.ndarray]):
        slots = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(hashes))))))
        self.languages, self.slices, self.rates = languages, [], []
        for k, mask in enumerate(masks):
            n = min(64, len(languages) - 64 * k)
            kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n <= bits)
            table = np.zeros(slots, kind)
            for at in self._slots(hashes, slots):
                np.bitwise_or.at(table, at, mask.astype(kind))
            self.slices.append(table)
            filled = np.array([np.count_nonzero(table & kind(1 << b)) / slots for b in range(n)])
            self.rates += list(filled**HASHES)

    @staticmethod
    def _slots(hashes: np.ndarray, slots: int) -> Iterator[np.ndarray]:
        step = mix(hashes) | np.uint64(1)
        for k in range(HASHES):
            yield ((hashes + np.uint64(k) * step) >> np.uint64(7)) & np.uint64(slots - 1)

    def lookup(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each slice, the bits of the languages that contain each n-gram."""
        found = None
        for at in self._slots(hashes, len(self.slices[0])):
            got = [t[at] for t in self.slices]
            found = got if found is None else [a & b for a, b in zip(found, got, strict=True)]
        return found

    def decide(self, c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language number (-1: no letter) and score of each document, and its n-grams."""
        docs, hashes, letters = _ngrams(c)
        total = np.bincount(docs, minlength=c.n)
        bits = self.lookup(hashes)
        counts = np.zeros((len(self.languages), c.n))
        for k, rate in enumerate(self.rates):
            one = bits[k // 64]
            hits = np.bincount(docs[(one & one.dtype.type(1 << (k % 64))) != 0], minlength=c.n)
            counts[k] = np.clip((hits - rate * total) / max(1e-9, 1 - rate), 0, None)
        best = counts.argmax(0)
        every = counts.sum(0)
        score = np.where(every > 0, counts.max(0) / np.maximum(every, 1e-9), 1 / len(self.languages))
        return np.where(letters > 0, best, -1), np.where(letters > 0, score, 0.0), total


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, least: int = 3, share: float = 0.01) -> Filter | None:
    """Learn from the documents for which learn holds and whose language is not null.

    A language contains an n-gram that at least share of its sampled
    documents have (and least of them, if it has that many times ten).  None:
    nothing to learn from.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull())
    ranked = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # The sample: a bounded number of ids for each language, found without the
    # texts.  Hashes under a threshold that some more than per_language ids of
    # the language are expected to pass come first, so what is ranked is as
    # small for a language of a third of all documents as for a rare one.
    held = {r["lang"]: r["n"] for r in ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not held:
        return None
    spare = per_language + 10 * int(per_language**0.5) + 50
    limit = F.create_map(*(x for k, n in held.items() for x in (F.lit(k), F.lit(min(1.0, spare / n)))))
    ranked = ranked.withColumn("hash", F.xxhash64("id")).where((F.col("hash") / 2.0**64 + 0.5) <= F.element_at(limit, F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    sample = ranked.withColumn("place", place).where(F.col("place") <= per_language).select("id", "lang")
    sizes = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    number = {x: k for k, x in enumerate(languages)}
    picked = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(sample.distinct()), ["id", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for c in chunks(batch.column("text"), lower=True):
                of, hashes, _ = _ngrams(c)
                pairs = np.unique(np.stack([of, hashes.view(np.int64)]), axis=1)
                both, n = np.unique(np.stack([langs[c.first : c.first + c.n][pairs[0]], pairs[1]]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n)], names=["lang", "gram", "n"])

    enough = F.coalesce(*(F.when(F.col("lang") == k, F.lit(max(1.0, min(least, sizes[x] / 10), share * sizes[x]))) for k, x in enumerate(languages)))
    found = picked.mapInArrow(run, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= enough)
    rows = found.select("lang", "gram").toPandas()  # bounded by the sample
    hashes, at = np.unique(rows["gram"].to_numpy(np.int64), return_inverse=True)
    masks = [np.zeros(len(hashes), np.uint64) for _ in range(-(-len(languages) // 64))]
    lang = rows["lang"].to_numpy(np.int64)
    for k in range(len(languages)):
        np.bitwise_or.at(masks[k // 64], at[lang == k], np.uint64(1 << (k % 64)))
    return Filter(languages, hashes.view(np.uint64), masks)


def identify(docs: DataFrame, model: Filter | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned.  Ties go to the language with more sampled documents, then
    by name.  Null ids are kept; rows that repeat are judged alike; long texts
    are read whole; an empty table gives an empty one; other columns are not
    read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs, scores = [], []
            for c in chunks(batch.column(1), lower=True):
                if model is None:
                    langs += ["und"] * c.n
                    scores.append(np.zeros(c.n))
                    continue
                best, score, _ = model.decide(c)
                langs += [model.languages[k] if k >= 0 else "und" for k in best]
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = identify(docs, fit(docs, fold != 2))
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
