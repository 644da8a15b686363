"""Removal of long repeated byte strings (list item 11), by prefix-free parsing.

A place is cut where the rolling hash of the bytes before it is the least in
its neighbourhood.  A cut depends on these few bytes only, so equal text is cut
alike wherever it stands: every window of ``size`` bytes has one first cut far
enough from its ends (its anchor), and windows are equal only if the bytes
around their anchors are.  Text without such a cut is parsed again with a
narrower neighbourhood; what has none even then (no text met yet) is an anchor
of its own.

1. Dictionary: each anchor has a key (a hash of the bytes that all its windows
   share) and a context (a hash of all that its windows cover).  Keys are
   counted over the whole corpus.
2. A key that occurs once anchors no repeated window; where a key occurs with
   one context only, all windows repeat.  Both hold for almost all anchors.
3. The rest is compared byte by byte in the order of suffix arrays: in each
   group of a key, the phrase suffixes (bytes before the anchor, read
   backwards) and the parse suffixes (bytes after it) are sorted; their ranks at
   depths e and size - e together give the corpus order of the windows that
   start e bytes before an anchor, and equal ranks are equal windows.
4. Keys with more anchors than GROUP are not gathered: their windows are
   counted one by one under 128-bit hashes.

What a document gets back are intervals; its text moves twice, compressed, in
the joins that read contexts and that cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .words import Chunk, chunks, mix

SIZE = 200
HASHED = 16  # bytes of the rolling hash
RADII = (32, 8)  # neighbourhoods of the first and of the second parse
GROUP = 1 << 15  # anchors of one key that one task compares: some 10 MB
HEAVY = 1024  # keys that have more than one in HEAVY of all rows are dealt to SALTS tasks
SALTS = 256
SINGLE, PURE, MIXED, LARGE = range(4)  # one occurrence; one context; several; several, too many to gather

_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(20).integers(1 << 62, dtype=np.uint64, size=(2, 256)) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for each process."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.ones(1 << max(n - 1, 1).bit_length(), np.uint64)
        k = 1
        while k < len(held):
            held[k : 2 * k] = held[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = held
    return held[:n]


class Hashes:
    """Hashes of any span of some bytes, from prefix sums."""

    def __init__(self, buf: np.ndarray, which: int):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[which][buf] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def rolling(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.back[:n]


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width numbers."""
    size = 1
    out = x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - size : width - size + n])


def cuts(rolling: np.ndarray, bounds: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose hash is the least of all within radius of it, and their documents; all bytes that decide lie inside the document."""
    if len(rolling) < 2 * radius + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(rolling[radius:-radius] == least(rolling, 2 * radius + 1)) + radius + HASHED
    of = np.searchsorted(bounds, at, "right") - 1
    inside = (at - HASHED - radius >= bounds[of]) & (at + radius <= bounds[of + 1])
    return at[inside], of[inside]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first .. last of each pair, one after the other."""
    size = last - first + 1
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class Anchors:
    """The anchors of a chunk: document, place, and the least and the greatest distance e of a window's start before it."""

    def __init__(self, c: Chunk, size: int):
        buf, bounds = c.buf, c.bounds
        self.buf, self.size = buf, size
        one = Hashes(buf, 0)
        rolling = (mix(one.rolling(HASHED)) >> np.uint64(32)).astype(np.uint32) if len(buf) >= HASHED else np.zeros(0, np.uint32)
        parts, left = [], None
        for level, radius in enumerate(RADII):
            low, high = HASHED + radius, size - radius
            at, of = cuts(rolling, bounds, radius)
            if left is None:
                before = np.full(len(at), -(1 << 40))
                before[1:][of[1:] == of[:-1]] = at[:-1][of[1:] == of[:-1]]
                first, last = np.maximum.reduce([bounds[of], at - high, before - low + 1]), np.minimum(at - low, bounds[of + 1] - size)
                has = first <= last
                first, last, at, of = first[has], last[has], at[has], of[has]
                # The starts between the intervals of a document have no anchor yet.
                whole = np.flatnonzero(np.diff(bounds) >= size)
                lows = np.concatenate((bounds[whole], last + 1))
                highs = np.concatenate((first - 1, bounds[whole + 1] - size))
                owner, order = np.concatenate((whole, of)), np.concatenate((of, whole))
                lows, highs = lows[np.lexsort((lows, owner))], highs[np.lexsort((highs, order))]
                open_ = lows <= highs
                left = ranges(lows[open_], highs[open_])
            else:
                k = np.searchsorted(at, left + low)
                found = k < len(at)
                k = np.minimum(k, max(len(at) - 1, 0))
                doc = np.searchsorted(bounds, left, "right") - 1
                if len(at):
                    found &= (at[k] <= left + high) & (of[k] == doc)
                starts, k, doc = left[found], k[found], doc[found]
                new = np.ones(len(starts), bool)
                new[1:] = (k[1:] != k[:-1]) | (starts[1:] != starts[:-1] + 1)
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(starts))[: len(head)] - 1
                first, last, at, of = starts[head], starts[tail], at[k[head]] if len(head) else head, doc[head]
                left = left[~found]
            parts.append((of, at, at - last, at - first, np.full(len(at), low), np.full(len(at), size - high), np.full(len(at), level)))
        doc, half = np.searchsorted(bounds, left, "right") - 1, np.full(len(left), size // 2)
        parts.append((doc, left + half, half, half, half, size - half, np.full(len(left), len(RADII))))
        self.of, self.at, self.low, self.high, before, after, level = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        kind = (level * 4096).astype(np.uint64)
        self.key = mix(one(self.at - before, self.at + after) + kind * np.uint64(_BASE)).view(np.int64)
        two = Hashes(buf, 1)
        span = two(self.at - self.high, self.at + size - self.low)
        self.context = mix(mix(span + (kind + self.low.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) + self.high.astype(np.uint64)).view(np.int64)
        self.hashes = one, two

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (document, key, context): its first anchor, how many there are, and for each anchor which of these it is."""
        order = np.lexsort((self.at, self.context, self.key, self.of))
        new = np.ones(len(order), bool)
        for x in (self.of, self.key, self.context):
            new[1:] &= x[order][1:] == x[order][:-1]
        new[1:] = ~new[1:]
        head = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[head], np.diff(np.append(head, len(order))), which


def _pack(texts: pd.Series) -> pd.Series:
    press = zstandard.ZstdCompressor(level=1)
    return pd.Series([press.compress(x.encode()) for x in texts], dtype=object)


def _unpacked(parts: pa.Array) -> pa.Array:
    press = zstandard.ZstdDecompressor()
    return pa.array([press.decompress(x) for x in parts.to_pylist()], pa.binary())


def _as_text(parts: pa.Array) -> pa.Array:
    """Bytes that are known to be UTF-8, as a string array of the same memory."""
    parts = parts.cast(pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(parts), parts.buffers(), offset=parts.offset)


def merged(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal intervals of each document, from intervals a .. b - 1 that may overlap or touch."""
    order = np.lexsort((a, of))
    of, a, b = of[order], a[order], b[order]
    shift = (of - of[0] if len(of) else of) * (1 << 40)
    reach = np.maximum.accumulate(b + shift)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] + shift[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return of[head], a[head], (reach[np.append(head[1:], len(a))[: len(head)] - 1] - shift[head]) if len(head) else a[head]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Text, and what tells a row from others: 96 bits of its id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("r1"), F.crc32(text).alias("r2"), text.alias("text"))


def repeated_keys(rows: DataFrame, size: int) -> DataFrame:
    """The keys that occur twice or more: what their contexts say, and how often they occur (a document counts a context twice at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                found = Anchors(c, size)
                head, n, _ = found.distinct()
                yield pa.RecordBatch.from_arrays([pa.array(found.key[head]), pa.array(found.context[head]), pa.array(np.minimum(n, 2))], names=["k", "f", "n"])

    counted = rows.select("text").mapInArrow(run, "k long, f long, n long").groupBy("k").agg(F.sum("n").alias("n"), F.min("f").alias("least"), F.max("f").alias("most"))
    state = F.when(F.col("least") == F.col("most"), PURE).when(F.col("n") <= GROUP, MIXED).otherwise(LARGE)
    return counted.where("n > 1").select("k", "n", state.alias("state"))


def salted(left: DataFrame, right: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """Inner join of many rows to the one of each key, which has their number n.

    A key with more than one in HEAVY of all rows (there are fewer than HEAVY of
    these) is dealt to SALTS tasks.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    # Fewer than HEAVY rows, whatever the corpus.
    names = [r[0] for r in right.where(heavy).select(on[0]).distinct().collect()]
    salt = F.when(F.col(on[0]).isin(names), F.pmod(spread, F.lit(SALTS))).otherwise(0) if names else F.lit(0)
    at = F.explode(F.when(F.col(on[0]).isin(names), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))) if names else F.lit(0)
    return left.withColumn("salt", salt.cast("int")).join(right.withColumn("salt", at), [*on, "salt"]).drop("salt")


def asked_keys(rows: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """Each row's repeated keys with their state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                found = Anchors(c, size)
                order = np.lexsort((found.key, found.of))
                new = np.ones(len(order), bool)
                new[1:] = (found.key[order][1:] != found.key[order][:-1]) | (found.of[order][1:] != found.of[order][:-1])
                head = order[new]
                at = pa.array(found.of[head] + c.first)
                yield pa.RecordBatch.from_arrays([pa.array(found.key[head]), batch.column(0).take(at), batch.column(1).take(at)], names=["k", "r1", "r2"])

    met = salted(rows.select("r1", "r2", "text").mapInArrow(run, "k long, r1 long, r2 long"), keys, ["k"], F.col("r1"))
    return met.groupBy("r1", "r2").agg(F.collect_set(F.struct("k", "state")).alias("asked"))


FOUND = "kind int, k long, f long, r1 long, r2 long, a long, b long, low int, high int, bytes binary"


def _found(kind: int, r1: pa.Array, r2: pa.Array, a: np.ndarray, b: np.ndarray, k=None, f=None, low=None, high=None, held=None) -> pa.RecordBatch:
    n = len(a)
    none = lambda kind_, x: pa.nulls(n, kind_) if x is None else pa.array(x, kind_)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), none(pa.int64(), k), none(pa.int64(), f), r1, r2, pa.array(a, pa.int64()), pa.array(b, pa.int64()), none(pa.int32(), low), none(pa.int32(), high), none(pa.binary(), held)],
        names=[x.split()[0] for x in FOUND.split(", ")],
    )


def contexts(rows: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """Rows of three kinds: PURE, an interval that repeats; MIXED, the bytes around an anchor; LARGE, the hash of a window."""
    packed = rows.select("r1", "r2", F.pandas_udf(_pack, "binary")("text").alias("packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts at a time are unpacked
                part = batch.slice(at, 64)
                r1, r2 = part.column(0), part.column(1)
                lists = part.column(3)
                for c in chunks(_as_text(_unpacked(part.column(2)))):
                    told = lists.slice(c.first, c.n).flatten()
                    keys, states = (np.asarray(told.field(x)) for x in ("k", "state"))
                    order = np.argsort(keys, kind="stable")
                    keys, states = keys[order], states[order]
                    found = Anchors(c, size)
                    place = np.minimum(np.searchsorted(keys, found.key), len(keys) - 1)
                    state = np.where(keys[place] == found.key, states[place], SINGLE)
                    head, n, which = found.distinct()
                    own = (state == PURE) | (n > 1)[which]  # repeats in the same document are known here
                    base = c.bounds[found.of]
                    of, a, b = merged(found.of[own], (found.at - found.high)[own] - base[own], (found.at - found.low)[own] + size - base[own])
                    ids = pa.array(of + c.first)
                    yield _found(PURE, r1.take(ids), r2.take(ids), a, b)
                    one = head[state[head] == MIXED]
                    raw = c.buf.tobytes()
                    held = [raw[x:y] for x, y in zip((found.at - found.high)[one].tolist(), (found.at - found.low + size)[one].tolist(), strict=True)]
                    ids = pa.array(found.of[one] + c.first)
                    rest = found.at[one] - c.bounds[found.of[one]]
                    yield _found(MIXED, r1.take(ids), r2.take(ids), rest, rest, k=found.key[one], low=found.low[one].astype(np.int32), high=found.high[one].astype(np.int32), held=held)
                    for many in np.array_split(head[state[head] == LARGE], 1 + len(head) // 4096):
                        starts = ranges((found.at - found.high)[many], (found.at - found.low)[many])
                        of = np.repeat(found.of[many], (found.high - found.low + 1)[many])
                        ids, a = pa.array(of + c.first), starts - c.bounds[of]
                        h = [mix(x(starts, starts + size)).view(np.int64) for x in found.hashes]
                        yield _found(LARGE, r1.take(ids), r2.take(ids), a, a + size, k=h[0], f=h[1])

    return packed.join(asked, ["r1", "r2"]).select("r1", "r2", "packed", "asked").mapInArrow(run, FOUND)


def _ordered(keys: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows of strings under their keys, and the common length of each with the one before it (-1 under another key)."""
    whole = np.concatenate((keys.astype(">i8").view(np.uint8).reshape(-1, 8), strings), axis=1)
    order = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
    held = whole[order]
    differ = held[1:] != held[:-1]
    common = np.where(differ.any(1), differ.argmax(1), whole.shape[1]) - 8
    return order, np.concatenate(([-1], np.where(common < 0, -1, common)))


def equal_windows(keys: np.ndarray, low: np.ndarray, high: np.ndarray, parts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and distance e of each window that equals a window of another row.

    A part is the bytes from high before an anchor to size - low after it.
    """
    n = len(keys)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    length = high + size - low
    middle = np.cumsum(length) - length + high  # the anchor in flat
    span = np.arange(high.max())
    left = np.where(span < high[:, None], flat[np.maximum(middle[:, None] - 1 - span, 0)], 0)
    span = np.arange((size - low).max())
    right = np.where(span < (size - low)[:, None], flat[np.minimum(middle[:, None] + span, len(flat) - 1)], 0)
    (by_left, left_common), (by_right, right_common) = _ordered(keys, left.astype(np.uint8)), _ordered(keys, right.astype(np.uint8))
    rank_left, rank_right = np.empty(n, np.int64), np.empty(n, np.int64)
    rows, distances = [], []
    for e in range(int(low.min()), int(high.max()) + 1):
        took = np.flatnonzero((low <= e) & (e <= high))
        if len(took) < 2:
            continue
        rank_left[by_left] = np.cumsum(left_common < e)
        rank_right[by_right] = np.cumsum(right_common < size - e)
        pair = rank_left[took] * (n + 1) + rank_right[took]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        twice = np.zeros(len(took), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        rows.append(took[twice])
        distances.append(np.full(int(twice.sum()), e))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(distances)) if rows else (none, none)


def compared(found: DataFrame, size: int, block: int = 8192) -> DataFrame:
    """The intervals that repeat, from the contexts of keys with several."""

    def intervals(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        at, low, high = (t.column(x).to_numpy().astype(np.int64) for x in ("a", "low", "high"))
        row, e = equal_windows(t.column("k").to_numpy(), low, high, t.column("bytes").to_pylist(), size)
        of, a, b = merged(row, at[row] - e, at[row] - e + size)
        ids = pa.array(of)
        return pa.RecordBatch.from_arrays([t.column(x).take(ids).combine_chunks() if x[0] == "r" else pa.array(y) for x, y in (("r1", 0), ("r2", 0), ("a", a), ("b", b))], names=["r1", "r2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= block:
                t = pa.concat_tables(held).combine_chunks()
                k = t.column("k").to_numpy()
                end = int(np.searchsorted(k, k[-1]))  # the last key may go on
                if end:
                    yield intervals([t.slice(0, end)])
                held = [t.slice(end)]
        if sum(map(len, held)):
            yield intervals(held)

    some = found.where(F.col("kind") == MIXED).select("k", "r1", "r2", "a", "low", "high", "bytes")
    return some.repartition("k").sortWithinPartitions("k").mapInArrow(run, "r1 long, r2 long, a long, b long")


def counted(found: DataFrame) -> DataFrame:
    """The intervals that repeat, from the windows that are counted one by one."""
    windows = found.where(F.col("kind") == LARGE)
    twice = windows.groupBy("k", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted(windows.select("k", "f", "r1", "r2", "a", "b"), twice, ["k", "f"], F.col("r1") + F.col("a")).select("r1", "r2", "a", "b")


def _spans(parts: pd.Series) -> pd.Series:
    out = []
    for p in parts:
        pairs = np.array([(x["a"], x["b"]) for x in p], np.int64)
        _, a, b = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
        out.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return pd.Series(out, dtype=object)


def _kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
    press, out = zstandard.ZstdDecompressor(), []
    for packed, gone in zip(texts, spans, strict=True):
        text, at, parts = press.decompress(packed), 0, []
        for s in gone if gone is not None else ():
            parts.append(text[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Remove each byte that a string of size bytes covers which also starts anywhere else.

    Returns the columns of docs without text_col, and kept (the bytes that
    stay, which need not be UTF-8 any more), spans (start and end of each
    maximal removed run, in bytes of the text), n_bytes, n_removed and n_spans;
    these replace columns of such names.

    Strings are judged on the input, never across documents.  size must be at
    least 120 (the first parse needs room for an anchor) and at most 255.

    Nulls: a null text is an empty one, a null id an id like others.  A row
    that repeats another, id and all, is a document of its own, so both lose
    all text of size bytes or more.  Texts under size bytes lose nothing.
    Ties cannot occur.  An empty table gives an empty table.  Other columns pass
    through, whatever their names.
    """
    if not 120 <= size <= 255:
        raise ValueError("size must be 120 to 255")
    rows = _rows(docs, id_col, text_col)
    keys = materialise(repeated_keys(rows, size), "repeat_keys")
    found = materialise(contexts(rows, asked_keys(rows, keys, size), size), "repeat_contexts")
    gone = found.where(F.col("kind") == PURE).select("r1", "r2", "a", "b").unionByName(compared(found, size)).unionByName(counted(found))
    spans = gone.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("parts")).select("r1", "r2", F.pandas_udf(_spans, "array<struct<start:long,end:long>>")("parts").alias("spans"))
    others = [c for c in docs.columns if c not in (text_col, "kept", "spans", "n_bytes", "n_removed", "n_spans")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.struct(F.lit(0).alias("_" + "".join(others)), *(F.col(c) for c in others)).alias("row"), F.pandas_udf(_pack, "binary")(text).alias("packed"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(F.col(id_col), text).alias("r1"), F.crc32(text).alias("r2"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    out = left.join(spans, ["r1", "r2"], "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(
        *(F.col(f"row.`{c}`").alias(c) for c in others),
        F.pandas_udf(_kept, "binary")("packed", "spans").alias("kept"),
        "spans",
        F.col("size").alias("n_bytes"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, i, md5(b[i:i + 199]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)
), starts AS (
  SELECT r, i FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)
), runs AS (
  SELECT r, min(i) AS a, max(i) + 199 AS z
  FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run
        FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM starts))
  GROUP BY r, run
), kept AS (
  SELECT r, a AS place, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) + 1 AS x, a - 1 AS y FROM runs
  UNION ALL
  SELECT d.r, octet_length(b) + 1, coalesce(m.z, 0) + 1, octet_length(b) FROM d LEFT JOIN (SELECT r, max(z) AS z FROM runs GROUP BY r) m USING (r)
), joined AS (
  SELECT r, string_agg(CASE WHEN x <= y THEN hex(b[x:y]) ELSE '' END, '' ORDER BY place) AS text FROM kept JOIN d USING (r) GROUP BY r
), sums AS (
  SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(text)) AS kept_sha256
FROM d JOIN joined USING (r) LEFT JOIN sums USING (r)
"""
