"""Quality rules by weak supervision (list item 2).

Rules look at one document and vote good, vote bad or abstain.  No labels are
used: expectation-maximisation over all documents estimates how often each
rule abstains and errs for good and for bad documents, and a document is kept
if its posterior probability of being good is high enough.

The votes of all documents are counted by pattern on the executors; a pattern
has three values for each of the rules, so at most 3**rules rows (in practice
some hundred) reach the driver, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .words import SPACE, chunks, doc_keys, windows

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_letters", "n_upper", "n_marks", "n_distinct_words", "n_symbol_words", "n_plain_ends", "n_short_words", "n_wide")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
# Leading bytes, which count once: Latin, Greek, Cyrillic, Semitic; then scripts from U+0800 on (but punctuation at U+2000 and forms at U+F000).
_WIDE = np.zeros(256, bool)
_WIDE[[0xE0, 0xE1, *range(0xE3, 0xEE)]] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE0)]] = True
_LETTER |= _WIDE
_END = np.zeros(256, bool)
_END[list(b".,;:!?\"')")] = True


def _features(texts: pa.Array) -> dict[str, np.ndarray]:
    got = {f: [] for f in FEATURES}
    for c in chunks(texts):
        starts, ends, docs = c.words()
        words = c.hashes(starts, ends)
        space, symbol = SPACE[c.buf], _SYMBOL[c.buf]
        got["n_words"].append(np.bincount(docs, minlength=c.n))
        got["word_chars"].append(c.per_doc(((c.buf & 0xC0) != 0x80) & ~space))
        got["n_symbols"].append(c.per_doc(symbol))
        got["n_letters"].append(c.per_doc(_LETTER[c.buf]))
        got["n_wide"].append(c.per_doc(_WIDE[c.buf]))
        got["n_upper"].append(c.per_doc(_UPPER[c.buf]))
        got["n_marks"].append(c.per_doc(_MARK[c.buf]))
        got["n_distinct_words"].append(np.bincount((np.unique(doc_keys(docs, words)) >> np.uint64(52)).astype(np.int64), minlength=c.n))
        seen = np.concatenate(([0], np.cumsum(symbol)))
        got["n_symbol_words"].append(np.bincount(docs[seen[ends] > seen[starts]], minlength=c.n))
        # A word that ends in a lower-case letter, a digit or usual punctuation.
        last = c.buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
        got["n_plain_ends"].append(np.bincount(docs[((last >= 97) & (last <= 122)) | (last >= 128) | _END[last] | ((last >= 48) & (last <= 57))], minlength=c.n))
        first = c.buf[starts] if len(starts) else last
        short = (ends - starts <= 4) & ((first >= 97) & (first <= 122) | (first >= 128)) & ((last >= 97) & (last <= 122) | (last >= 128) | (last == 44) | (last == 46))
        got["n_short_words"].append(np.bincount(docs[short], minlength=c.n))
        a, b, of = c.lines()
        filled = np.concatenate(([0], np.cumsum(~space)))
        has = filled[b] > filled[a]
        a, b, of = a[has], b[has], of[has]
        n_lines = np.bincount(of, minlength=c.n)
        distinct = np.unique(doc_keys(of, c.hashes(a, b)))
        got["n_word_lines"].append(n_lines)
        got["n_dup_lines"].append(n_lines - np.bincount((distinct >> np.uint64(52)).astype(np.int64), minlength=c.n))
        hashes, at = windows(words, docs, 5)
        keys = doc_keys(docs[at], hashes)
        ordered = np.sort(keys)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        again = at[np.isin(keys, twice)] if len(twice) else at[:0]
        cover = np.zeros(len(docs) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.subtract.at(cover, again + 5, 1)
        got["n_repeat_words"].append(np.bincount(docs[np.cumsum(cover)[:-1] > 0], minlength=c.n))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in got.items()}


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the counts in FEATURES of every whole text; a null text has none."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(f, T.LongType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[f]) for f in FEATURES)], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def rules() -> dict[str, tuple[str, str]]:
    """name -> (condition for a vote good, condition for a vote bad); neither: the rule abstains.

    Conditions are SQL over FEATURES.  Most rules know one sort of junk and
    abstain elsewhere; the last three also know signs of running prose.  What
    they know holds for scripts of short letters and spaced words: where over
    a fifth of the characters are of other scripts (n_wide), they abstain, and
    so does the rule on capitals.
    """
    known = "5 * n_wide <= word_chars and "
    found = {
        "symbols": ("false", "10 * n_symbols > n_words"),
        "symbol_words": ("false", "100 * n_symbol_words > 15 * n_words"),
        "word_ends": ("false", "100 * n_plain_ends < 80 * n_words"),
        "upper_case": ("false", "100 * n_upper > 30 * n_letters"),
        "marks": ("false", "100 * n_marks > 20 * n_words"),
        "repetition": ("false", "100 * n_repeat_words > 20 * n_words"),
        "variety": ("false", "n_words >= 30 and 100 * n_distinct_words < 10 * n_words"),
        "duplicate_lines": ("false", "n_word_lines >= 4 and 100 * n_dup_lines > 50 * n_word_lines"),
        "word_length": ("word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
        "short_words": ("100 * n_short_words >= 15 * n_words", "n_words >= 30 and 100 * n_short_words < 4 * n_words"),
        "plain_prose": ("100 * n_plain_ends >= 97 * n_words and 100 * n_upper <= 15 * n_letters", "n_letters < n_words"),
    }
    for name in ("upper_case", "word_ends", "variety", "word_length", "short_words", "plain_prose"):
        found[name] = tuple(c if c == "false" else f"{known}({c})" for c in found[name])
    return found


def votes(features: DataFrame) -> list:
    """One column for each rule: 1 good, -1 bad, 0 abstains."""
    return [F.when(F.col("n_words") < 1, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int").alias(f"vote_{name}") for name, (good, bad) in rules().items()]


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.9, accuracy: float = 0.85, strength: float = 20.0, rounds: int = 500) -> tuple[float, np.ndarray]:
    """EM over vote patterns (-1, 0, 1): P(good), and how often a vote of each rule is right.

    Whether a rule abstains says nothing about the document.  Priors worth
    strength documents say that votes are right with the given accuracy; they
    fix which class is which and keep tiny corpora from degenerate estimates.
    """
    theta, good = np.full(patterns.shape[1], accuracy), prior
    voted = (counts[:, None] * (patterns != 0)).sum(0)
    for _ in range(rounds):
        p, before = posterior(patterns, good, theta), (good, theta)
        agree = (counts[:, None] * (p[:, None] * (patterns == 1) + (1 - p)[:, None] * (patterns == -1))).sum(0)
        # A rule is never taken for its opposite.
        theta = np.clip((agree + strength * accuracy) / (voted + strength), 0.5, 0.999)
        good = ((counts * p).sum() + strength * prior) / (counts.sum() + strength)
        if abs(good - before[0]) < 1e-10 and np.abs(theta - before[1]).max() < 1e-9:
            break
    return good, theta


def posterior(patterns: np.ndarray, good: float, theta: np.ndarray) -> np.ndarray:
    odds = np.log(good / (1 - good)) + patterns @ np.log(theta / (1 - theta))
    return 1 / (1 + np.exp(-odds))


def estimate(features: DataFrame) -> dict:
    """What EM finds over all documents: P(good), and how often the votes of each rule are right."""
    cols = [f"vote_{n}" for n in rules()]
    rows = features.select(*votes(features)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n_documents")).collect()  # at most 3 ** rules rows
    patterns = np.array([[r[c] for c in cols] for r in rows], int).reshape(-1, len(cols))
    good, theta = fit(patterns, np.array([r["n_documents"] for r in rows], float))
    return {"good": good, "accuracy": {n: float(theta[k]) for k, n in enumerate(rules())}}


def verdict(features: DataFrame, estimates: dict, threshold: float) -> DataFrame:
    """features with votes, base_failed, quality (the posterior) and kept."""
    out = features.select("*", *votes(features))
    odds = F.lit(float(np.log(estimates["good"] / (1 - estimates["good"]))))
    for name, right in estimates["accuracy"].items():
        odds = odds + F.col(f"vote_{name}") * float(np.log(right / (1 - right)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each document: id_col, FEATURES, votes, base_failed, quality, kept.

    A null or empty text has no words and fails the base rules.  A null id is
    kept as it is, and rows that repeat are judged one by one, alike.  An
    empty table gives an empty result.  Columns of docs other than the two
    named are not read.
    """
    features = materialise(document_features(docs, id_col, text_col), "features")
    return verdict(features, estimate(features), threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules() keeps, all columns, in any order.

    Nulls, empty texts, null ids, repeats, empty tables and long texts are
    judged as there; columns pass through, whatever their names.

    Once the rules' accuracies are known a verdict depends on the text alone,
    so texts are judged where they are read and nothing is joined.
    """
    estimates = estimate(document_features(docs, id_col, text_col))
    names = [f"c{k}" for k in range(len(docs.columns))]
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)), *(T.StructField(f, T.LongType()) for f in FEATURES)])
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(batch.column(text_at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[f]) for f in FEATURES)], names=schema.names)

    judged = verdict(docs.toDF(*names).mapInArrow(run, schema), estimates, threshold)
    return judged.where("kept").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
