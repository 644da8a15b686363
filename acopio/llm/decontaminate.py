"""Benchmark decontamination (list item 9).

Texts and items are sequences of words (runs of lower-cased letters and
digits).  A passage is contaminated if its word edit distance to an item is at
most ``max_edits`` times the item's words.

Windows as long as an item are walked by the CGK random walk: the step copies
a word and, by a random bit that depends on step and word, moves on or stays,
which turns edit distance into Hamming distance.  Windows and items that agree
in a few sampled steps of a walk are candidates; walks and samples repeat as
often as a simulation with that many edits, and with the windows as they are
found (below; off by some words), needs for the target recall.  There is one
simulation for each class of lengths (CLASSES), whatever the benchmark.  Exact
edit distance decides.

Longer items, and those for which WALKS walks would not reach the recall, need
no walks: every window that holds enough of an item's words is verified, and
windows that overlap are verified as one stretch.

Which windows are walked: an item with at most k edits, cut into k + 1 parts,
has at least one part left unchanged, so only windows around an occurrence of
such a part can match.  This loses nothing at any distance up to k.  Items of
fewer than ``MIN_WORDS`` words are one part, and match only word for word.

Items are read to the driver in blocks of about ``BLOCK`` characters, one block
at a time, so its memory does not grow with the benchmark; texts are scanned
where they lie, once for each block, and are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, table
from .words import chunks, mix, windows

MAX_EDITS, RECALL, SAMPLED, MIN_WORDS, BLOCK = 0.2, 0.99, 3, 8, 16_000_000
WALKS = 256  # lengths that need more are verified without walks
CLASSES = (8, 12, 16, 24, 32, 48, 64)  # an item has the walks of the next of these lengths; longer ones have none
CELLS = 1 << 21  # words of contexts that are held at once
_END = np.uint64(0)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def walk(x: np.ndarray, seed: int) -> np.ndarray:
    """CGK: rows of n words each to rows of 3 n words; past its end a row gives the end mark."""
    m, n = x.shape
    out, at, rows = np.empty((m, 3 * n), np.uint64), np.zeros(m, np.int64), np.arange(m)
    held = np.concatenate((x, np.full((m, 1), _END)), axis=1)
    for j in range(3 * n):
        word = held[rows, at]
        out[:, j] = word
        at += (mix(word + np.uint64(((seed << 20) + j) * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(1)).astype(np.int64)
        np.minimum(at, n, out=at)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits of item to a stretch of text, and the stretch (first word, word after the last).

    Ties: the stretch that ends first, then the shortest.
    """
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, word in enumerate(item.tolist()):
        # Cost and start in one number: less cost first, then the later start.
        down = (cost + 1) * (n + 2) - start
        over = np.concatenate(([(k + 1) * (n + 2)], (cost[:-1] + (text != word)) * (n + 2) - start[:-1]))
        best = np.minimum(down, over)
        best = np.minimum.accumulate(best - steps * (n + 2)) + steps * (n + 2)
        cost = -(-best // (n + 2))
        start = cost * (n + 2) - best
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Index:
    """The items of a block, by length: their parts, walks and sampled keys."""

    def __init__(self, items: list[tuple[object, str]], max_edits: float, recall: float, sampled: int, min_words: int):
        self.ids, self.words, self.edits = [], [], []
        texts = pa.array([t for _, t in items], pa.string())
        for c in chunks(texts, lower=True):
            starts, ends, docs = c.spans(_WORD[c.buf])
            h, cuts = c.hashes(starts, ends) | np.uint64(1), np.searchsorted(docs, np.arange(c.n + 1))
            for d in range(c.n):
                own = h[cuts[d] : cuts[d + 1]]
                if len(own):
                    self.ids.append(items[c.first + d][0])
                    self.words.append(own)
                    self.edits.append(int(max_edits * len(own) + 1e-9) if len(own) >= min_words else 0)
        self.max_edits, self.recall, self.sampled = max_edits, recall, sampled
        self.by_length = defaultdict(list)
        for k, own in enumerate(self.words):
            self.by_length[len(own)].append(k)
        plans: dict[int, list | None] = {}
        self.tables, self.whole = {}, set()  # lengths with walks; items without
        for n, own in self.by_length.items():
            size = min((c for c in CLASSES if c >= n), default=None)
            if size is not None and size not in plans:
                plans[size] = self._repetitions(size, int(max_edits * size + 1e-9) if size >= min_words else 0)
            if size is None or plans[size] is None:
                self.whole.update(own)
            else:
                self.tables[n] = self._table(n, plans[size])
        parts, whole_parts = defaultdict(list), defaultdict(list)  # part length -> (hash, item length or item, place in the item)
        for k, (own, edits) in enumerate(zip(self.words, self.edits, strict=True)):
            size = len(own) // (edits + 1)
            h, at = windows(own, np.zeros(len(own), int), size)
            (whole_parts if k in self.whole else parts)[size] += [(int(h[p * size]), k if k in self.whole else len(own), p * size) for p in range(edits + 1)]
        self.parts, self.whole_parts = ({size: self._sorted(found) for size, found in x.items()} for x in (parts, whole_parts))
        self.bags = {k: np.unique(self.words[k]) for k in self.whole}

    @staticmethod
    def _sorted(found: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, what they stand for, and a filter of them."""
        found = sorted(set(found))
        keys = np.array([f[0] for f in found], np.uint64)
        seen = np.zeros(1 << 20, bool)
        seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return keys, np.array([f[1:] for f in found], np.int64), seen

    @staticmethod
    def _hits(held: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are keys, and a row of what the key stands for, for each of its rows."""
        keys, values, seen = held
        near = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        low, high = np.searchsorted(keys, h[near], "left"), np.searchsorted(keys, h[near], "right")
        n = high - low
        which = np.repeat(np.arange(len(near)), n)
        return near[which], values[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]]

    def _table(self, n: int, plan: list[tuple[int, list[np.ndarray]]]) -> tuple[list[tuple[int, list[np.ndarray]]], list[dict[int, list[int]]]]:
        """The (seed, sampled steps) repetitions for items of n words, and key -> items for each repetition."""
        items = np.stack([self.words[k] for k in self.by_length[n]])
        # Steps were drawn for the class; a shorter item takes them in proportion.
        size = min(c for c in CLASSES if c >= n)
        plan = [(seed, [steps * n // size for steps in groups]) for seed, groups in plan]
        tables = []
        for seed, groups in plan:
            walked = walk(items, seed)
            for steps in groups:
                table = defaultdict(list)
                for k, key in zip(self.by_length[n], _key(walked, steps).tolist(), strict=True):
                    table[key].append(k)
                tables.append(dict(table))
        return plan, tables

    def _repetitions(self, n: int, edits: int, draws: int = 192, per_walk: int = 4) -> list[tuple[int, list[np.ndarray]]] | None:
        """As many walks, with per_walk samples each, as reach the recall for items of n words with all allowed edits; None if WALKS do not.

        A drawn item is edited and put among other words; what is walked are
        the windows that its unchanged parts give, as in windows_near().
        """
        draw = np.random.default_rng(n)
        size, pad = n // (edits + 1), n + edits
        base = np.stack([_fresh(n, draw) for _ in range(draws)])
        of, rows = [], []
        for k, x in enumerate(base):
            text = np.concatenate((_fresh(pad, draw), _edited(x, edits, draw), _fresh(pad, draw)))
            runs = np.lib.stride_tricks.sliding_window_view(text, size)
            starts = {int(at) - p * size for p in range(edits + 1) for at in np.flatnonzero((runs == x[p * size : (p + 1) * size]).all(1))}
            for at in sorted(a for a in starts if 0 <= a <= len(text) - n):
                of.append(k)
                rows.append(text[at : at + n])
        of, near = np.array(of), np.stack(rows)
        met, plan = np.zeros(draws, bool), []
        while met.mean() < self.recall or len(plan) < 4:
            if len(plan) == WALKS:
                return None
            seed = len(plan) + 1
            groups = [np.sort(draw.choice(2 * n, min(self.sampled, 2 * n), replace=False)) for _ in range(per_walk)]
            a, b = walk(base, seed), walk(near, seed)
            for steps in groups:
                met[of[(a[of][:, steps] == b[:, steps]).all(1)]] = True
            plan.append((seed, groups))
        return plan

    def windows_near(self, words: np.ndarray, docs: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Item length; documents, first words and contexts of the windows around parts of items.

        A context is the window and as many words on both sides as edits are
        allowed; places outside the document are 2, which is no word.  Contexts
        come in blocks of CELLS words at most.
        """
        starts = []  # document, item length, first word of the window in the document
        for size, held in self.parts.items():
            h, at = windows(words, docs, size)
            near, place = self._hits(held, h)
            if len(near):
                word = at[near]
                starts.append((place[:, 0] << 44) | ((word - place[:, 1] + (1 << 20)) << 12) | docs[word])
        if not starts:
            return
        found = np.unique(np.concatenate(starts))
        length, start, of = found >> 44, ((found >> 12) & ((1 << 32) - 1)) - (1 << 20), found & 0xFFF
        for n in np.unique(length).tolist():
            own, edits = np.flatnonzero(length == n), self.edits[self.by_length[n][0]]
            for some in np.array_split(own, 1 + len(own) * (n + 2 * edits) // CELLS):
                doc, at = of[some], start[some]
                place = at[:, None] + np.arange(-edits, n + edits)
                inside = (place >= first[doc][:, None]) & (place < first[doc + 1][:, None])
                yield n, doc, at - first[doc], np.where(inside, words[np.where(inside, place, 0)], np.uint64(2))

    def whole_near(self, words: np.ndarray, docs: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        """Document, item, and (least edits, stretch) for the items without walks.

        Starts of windows around unchanged parts are merged where the windows
        overlap.  A stretch is verified where some place of it has, within an
        item's words and edits, as many words of the item as must be left.
        """
        starts = defaultdict(list)
        for size, held in self.whole_parts.items():
            h, at = windows(words, docs, size)
            near, value = self._hits(held, h)
            for k in np.unique(value[:, 0]).tolist():
                own = value[:, 0] == k
                starts[k].append(np.stack((docs[at[near[own]]], at[near[own]] - value[own, 1])))
        for k, found in starts.items():
            n, edits = len(self.words[k]), self.edits[k]
            of, at = np.unique(np.concatenate(found, axis=1), axis=1)
            low, high = np.maximum(at - edits, first[of]), np.minimum(at + n + edits, first[of + 1])
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (low[1:] > np.maximum.accumulate(high)[:-1])
            head = np.flatnonzero(new)
            for a, b in zip(head.tolist(), [*head[1:].tolist(), len(of)], strict=True):
                doc, begin, end = int(of[a]), int(low[a]), int(high[a:b].max())
                text = words[begin:end]
                in_item = np.concatenate(([0], np.cumsum(np.isin(text, self.bags[k]))))
                width = min(n + edits, len(text))  # a match has at most so many words
                if (in_item[width:] - in_item[: len(in_item) - width]).max() < n - edits:
                    continue
                cost, x, y = edit_distance(self.words[k], text)
                if cost <= edits:
                    shift = begin - int(first[doc])
                    yield doc, k, (cost, shift + x, shift + y)

    def decide(self, found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> least edits and the stretch (word places in the document)."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, parts in sorted(found.items()):
            docs, starts, contexts = (np.concatenate(p) for p in zip(*parts, strict=True))
            edits = self.edits[self.by_length[n][0]]
            distinct, back = np.unique(contexts, axis=0, return_inverse=True) if len(contexts) > 64 else (contexts, np.arange(len(contexts)))
            x, pairs, k = distinct[:, edits : edits + n], set(), 0
            plan, tables = self.tables[n]
            for seed, groups in plan:
                walked = walk(x, seed)
                for steps in groups:
                    table = tables[k]
                    k += 1
                    for row, key in enumerate(_key(walked, steps).tolist()):
                        if key in table:
                            pairs.update((row, item) for item in table[key])
            where = defaultdict(list)
            for row, to in enumerate(back.ravel().tolist()):
                where[to].append(row)
            for row, item in sorted(pairs):
                cost, a, b = edit_distance(self.words[item], distinct[row])
                if cost <= edits:
                    for one in where[row]:
                        doc, shift = int(docs[one]), int(starts[one]) - edits
                        out[doc, item] = min(out.get((doc, item), (1 << 30, 0, 0)), (cost, shift + a, shift + b))
        return out


def _fresh(n: int, draw: np.random.Generator) -> np.ndarray:
    """n words that no item has."""
    return draw.integers(1 << 62, size=n).astype(np.uint64) | np.uint64(1)


def _edited(x: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """x with so many random substitutions, insertions and deletions."""
    out = x.tolist()
    for _ in range(edits):
        kind, at, word = draw.integers(3), int(draw.integers(max(1, len(out)))), int(_fresh(1, draw)[0])
        if kind == 0 and out:
            out[at] = word
        elif kind == 1:
            out.insert(at, word)
        elif out:
            del out[at]
    return np.array(out, np.uint64)


def _key(walked: np.ndarray, steps: np.ndarray) -> np.ndarray:
    key = np.full(len(walked), 7, np.uint64)
    for s in steps:
        key = mix(key * np.uint64(31) + walked[:, s])
    return key


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about block characters there are, and the items of each, read one by one."""
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0]
    of = -(-total // block) if total else 0

    def read() -> Iterator[list[tuple]]:
        for k in range(of):
            part = items if of == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(of)) == k)
            yield sorted(((r["id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x))  # about block characters

    return of, read()


def _matcher(index: Index) -> Callable:
    def scan(texts: pa.Array) -> Iterator[tuple[int, int, tuple[int, int, int]]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found, cells = defaultdict(list), 0

        def note(key: tuple[int, int], match: tuple[int, int, int]) -> None:
            best[key] = min(best.get(key, match), match)

        for c in chunks(texts, lower=True):
            starts, ends, docs = c.spans(_WORD[c.buf])
            words = c.hashes(starts, ends) | np.uint64(1)
            first = np.searchsorted(docs, np.arange(c.n + 1))
            for n, of, at, context in index.windows_near(words, docs, first):
                found[n].append((of + c.first, at, context))
                cells += context.size
                if cells >= CELLS:  # windows of many chunks are walked together
                    for key, match in index.decide(found).items():
                        note(key, match)
                    found, cells = defaultdict(list), 0
            for doc, item, match in index.whole_near(words, docs, first):
                note((doc + c.first, item), match)
        for key, match in index.decide(found).items():
            note(key, match)
        for (doc, item), match in best.items():
            yield doc, item, match

    return scan


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS, recall: float = RECALL, sampled: int = SAMPLED, min_words: int = MIN_WORDS, block: int = BLOCK) -> DataFrame:
    """One row for each document and item in it: id_col, item_col, start_word, end_word, edits, item_words.

    The stretch is the one with fewest edits, then the first.  Items of fewer
    than min_words words match word for word only.  Null and empty texts match
    nothing, nor do items without words.  Null ids are kept; repeated rows and
    items are reported each; texts are searched whole, however long; an empty
    table on either side gives no rows; other columns are not read.
    """
    kind = benchmark.schema[item_col].dataType
    schema = T.StructType([docs.schema[id_col], T.StructField("item", kind), *(T.StructField(c, T.IntegerType()) for c in ("start_word", "end_word", "edits", "item_words"))])
    out = None
    of, read = _blocks(benchmark, item_col, item_text, block)
    for items in read:
        held = docs.sparkSession.sparkContext.broadcast(Index(items, max_edits, recall, sampled, min_words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            scan = _matcher(index)
            for batch in batches:
                rows = [(d, index.ids[i], a, b, e, len(index.words[i])) for d, i, (e, a, b) in scan(batch.column(1))]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa_type), *(pa.array(x, pa.int32()) for x in cols[2:])], names=schema.names)

        pa_type = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()
        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        if of > 1:  # one block in memory at a time
            part = materialise(part, "matches")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is found; all columns, no shuffle.

    Nulls, empty and long texts, short items and empty tables as in
    find_matches(); repeated rows are judged alike, and columns pass through,
    whatever their names.
    """
    options = {"max_edits": MAX_EDITS, "recall": RECALL, "sampled": SAMPLED, "min_words": MIN_WORDS} | options
    at = docs.columns.index(text_col)
    of, read = _blocks(benchmark, item_col, item_text, options.pop("block", BLOCK))
    for items in read:
        held = docs.sparkSession.sparkContext.broadcast(Index(items, **options))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            scan = _matcher(held.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for doc, _, _ in scan(batch.column(at)):
                    keep[doc] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
        if of > 1:
            docs = materialise(docs, "clean")
            held.destroy()
    return docs


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
