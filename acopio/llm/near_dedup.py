"""Near-duplicate documents by weighted sampling (list item 6).

Equal texts are one node.  A document is the bag of its five-word shingles
(all its words, if it has fewer), each weighted by term frequency times
inverse document frequency.  Improved consistent weighted sampling draws
``bands * rows`` samples of it; two documents draw the same sample with the
probability of their weighted Jaccard similarity.  Samples are banded, nodes
that meet in a bucket become candidate pairs, and exact weighted Jaccard
similarity of at least ``threshold`` makes a link.  Linked nodes form classes.

Document frequencies are counted over all documents in two rows of 2**18
counters by shingle hash (a table of fixed size, the same at every size of the
corpus) and floored at one document in a hundred: below that, shingles weigh
alike.  Without the floor the text that a large group of copies shares would
lose weight against their small differences as the group grows.

In a bucket every node is paired with one leader, so a bucket costs as much
as it has nodes, not as their square.  Where that leaves a bucket with nodes
of different classes, a small bucket is paired fully between its classes, and
the nodes of a large one (many texts around one shared passage) are banded
anew with twice as many samples in a band and more bands, which tells them
apart and finds pairs at the threshold as surely as the first banding.  What
still holds several classes is compared block by block, so that every pair of
different classes that meets in a bucket of the second banding is tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_materialised, key128, materialise, materialise_counted, table
from .graph import components, merged
from .words import Chunk, chunks, doc_keys, mix, windows

SIZE, BANDS, ROWS, THRESHOLD = 5, 16, 5, 0.8
DEEP_BANDS, DEEP_ROWS = 64, 10
COUNTERS, FLOOR = 1 << 18, 0.01
SMALL_BUCKET = 24
BLOCK, COLUMNS = 256, 4096
_HASH = np.uint64((1 << 52) - 1)


def shingles(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 52-bit hash and term frequency of the distinct shingles, sorted by both."""
    starts, ends, docs = c.words()
    words = c.hashes(starts, ends)
    hashes, at = windows(words, docs, SIZE)
    docs_of = docs[at]
    n = np.bincount(docs, minlength=c.n)
    first = np.concatenate(([0], np.cumsum(n)))
    for d in np.flatnonzero((n > 0) & (n < SIZE)):
        x = np.uint64(n[d])
        for w in words[first[d] : first[d + 1]]:
            x = mix(np.array([x]) * np.uint64(31) + w)[0]
        hashes, docs_of = np.append(hashes, x), np.append(docs_of, d)
    keys, tf = np.unique(doc_keys(docs_of, hashes), return_counts=True)
    return (keys >> np.uint64(52)).astype(np.int64), keys & _HASH, tf


def _counter(hashes: np.ndarray, row: int) -> np.ndarray:
    """The counter of each hash in a row; of the lower 32 bits, which is what is kept of it."""
    return ((hashes >> np.uint64(14 * row)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def idf_table(docs: DataFrame, text_col: str) -> np.ndarray:
    """The weight of each counter: 1 for shingles in all documents, 2 for those in a share of FLOOR or less.

    Equal to 1 + ln(N / df) / ln(1 / floor), with df floored.  A shingle has a
    counter in each of two rows, and the smaller count is its own (weigh()),
    so that a rare shingle looks frequent only if it meets frequent ones in
    both rows: with f frequent shingles in the corpus at (f / COUNTERS)**2.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, COUNTERS), np.int64), 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                docs, hashes, _ = shingles(c)
                for row in range(2):
                    counts[row] += np.bincount(_counter(hashes, row), minlength=COUNTERS)
                n += len(np.unique(docs))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts.ravel()[at], n))], names=["counter", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    held = rows.toArrow()  # 2 * COUNTERS + 1 rows at most, 12 bytes each; as Row objects they would take hundreds of MB
    at, n = held["counter"].to_numpy(), held["n"].to_numpy()
    total = max(1, int(n[at < 0].sum()))
    df = np.zeros(2 * COUNTERS)
    df[at[at >= 0]] = n[at >= 0]
    # Counters that many rare shingles share must not look like a frequent one.
    floor = min(0.5, max(FLOOR, 1 / total, 4 * float(np.median(df)) / total))
    return (1 + np.log(1 / np.clip(df / total, floor, 1)) / np.log(1 / floor)).astype(np.float32).reshape(2, COUNTERS)


def weigh(hashes: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.maximum(idf[0][_counter(hashes, 0)], idf[1][_counter(hashes, 1)]) * tf.astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling.

    The random r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1) of sample k
    and a shingle are those of one of 2**draw_bits draws that the shingle's
    hash picks.  A sample is the least of ln c - r (t + 1 - b) over the shingles,
    t = floor(ln w / r + b), as an ordered integer with the shingle's hash
    behind it: equal for two documents if shingle and t are.
    """

    def __init__(self, samples: int, usual: float, seed: int, draw_bits: int):
        draw = np.random.default_rng(seed)
        n, self.shift = 1 << draw_bits, np.uint64(64 - draw_bits)
        self.r = draw.gamma(2, 1, (samples, n)).astype(np.float32)
        self.ln_c = np.log(draw.gamma(2, 1, (samples, n))).astype(np.float32)
        self.b = draw.random((samples, n)).astype(np.float32)
        self.pick = (draw.integers(1, 1 << 63, samples, np.uint64) << np.uint64(1)) | np.uint64(1)
        self.usual = np.float32(usual)
        # Most shingles have the same weight: their values are looked up.
        self.held = np.stack([self._value(k, np.arange(n), np.full(n, self.usual)) for k in range(samples)])

    def _value(self, k: int, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        r, b = self.r[k][at], self.b[k][at]
        t = np.floor(np.log(weight) / r + b)
        bits = (self.ln_c[k][at] - r * (t + 1 - b)).astype(np.float32).view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def samples(self, docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have shingles, and their samples, one row for each k."""
        present, first = np.unique(docs, return_index=True)
        other = np.flatnonzero(weights != self.usual)
        low, rare = hashes & np.uint64(0xFFFFFFFF), weights[other]
        out = np.empty((len(self.pick), len(present)), np.uint64)
        for k, pick in enumerate(self.pick):
            at = ((hashes * pick) >> self.shift).astype(np.int64)
            value = self.held[k][at]
            if len(other):
                value[other] = self._value(k, at[other], rare)
            out[k] = np.minimum.reduceat(value | low, first) if len(present) else 0
        return present, out


    def bands(self, docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have shingles, and the keys of their bands."""
        present, drawn = self.samples(docs, hashes, weights)
        keys = np.empty((bands, len(present)), np.uint64)
        for b in range(bands):
            x = np.full(len(present), b, np.uint64)
            for k in range(rows):
                x = mix(x * np.uint64(31) + drawn[b * rows + k])
            keys[b] = x
        return present, keys.T.view(np.int64)


_samplers: dict = {}


def _sampler(samples: int, usual: float, seed: int, draw_bits: int) -> Sampler:
    """One for each process and setting."""
    key = (samples, usual, seed, draw_bits)
    if key not in _samplers:
        _samplers.clear()
        _samplers[key] = Sampler(*key)
    return _samplers[key]


def signatures(docs: DataFrame, id_col: str, text_col: str, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, node (the text's key) and the keys of its bands (none without words)."""
    held = docs.sparkSession.sparkContext.broadcast(idf)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        sampler = _sampler(bands * rows, float(idf.max()), 20170, 15)
        for batch in batches:
            keys: list = [[]] * batch.num_rows
            for c in chunks(batch.column(2)):
                of, hashes, tf = shingles(c)
                present, own = sampler.bands(of, hashes, weigh(hashes, tf, idf), bands, rows)
                for d, one in zip(present.tolist(), own.tolist(), strict=True):
                    keys[c.first + d] = one
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), node_key(F.col(text_col)).alias("node"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def deep_signatures(sets: DataFrame, idf: np.ndarray, bands: int = DEEP_BANDS, rows: int = DEEP_ROWS) -> DataFrame:
    """(node, ids, tf) -> node and the keys of longer bands, from samples of their own."""
    held = sets.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        sampler = _sampler(bands * rows, float(idf.max()), 20171, 12)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(x.as_py(), "<u8") for x in part.column(1)]
                tf = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in part.column(2)])
                of, hashes = np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate(ids)
                present, own = sampler.bands(of, mix(hashes), weigh(hashes, tf, idf), bands, rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(present)), pa.array(own.tolist(), pa.list_(pa.int64()))], names=["node", "bands"])

    return sets.select("node", "ids", "tf").mapInArrow(run, "node string, bands array<long>")


def _members(banded: DataFrame) -> DataFrame:
    """bucket, node, n, leader for the buckets with two nodes or more."""
    buckets = banded.select("node", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    return materialise(buckets.join(sizes, "bucket").select("bucket", "node", "n", "leader"), "members")


def _stars(members: DataFrame) -> DataFrame:
    return members.where("node <> leader").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct()


def _open(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, dict]:
    """The members, with their classes, of the buckets that hold more than one class; top is a bucket's largest class (size, class).

    A bucket has one row in split, so no member is met twice.
    """
    placed = materialise(members.join(classes, "node", "left").select("bucket", "n", "node", F.coalesce("component", "node").alias("class")), "placed")
    sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket")
    split = sizes.agg(F.max(F.struct("size", "class")).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("bucket", "top")
    out = materialise_counted(placed.join(split, "bucket"), "open", large=F.count_if(F.col("n") > SMALL_BUCKET), all=F.count(F.lit(1)))
    drop_materialised(placed)
    return out


def _across(open_: DataFrame) -> DataFrame:
    """All pairs between different classes in small buckets."""
    few = open_.where(F.col("n") <= SMALL_BUCKET)
    return few.alias("a").join(few.alias("b"), "bucket").where("a.class <> b.class and a.node < b.node").select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def _class_stars(open_: DataFrame) -> DataFrame:
    """In large buckets one node of each class against one leader."""
    drawn = open_.where(F.col("n") > SMALL_BUCKET).groupBy("bucket", "class").agg(F.min("node").alias("node"))
    leads = drawn.groupBy("bucket").agg(F.max("node").alias("lead"))
    return drawn.join(leads, "bucket").where("node <> lead").select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"))


def _blocks(open_: DataFrame) -> DataFrame:
    """bucket, i, j, node, class, block: the nodes of large buckets, once for each pair of blocks to compare.

    The nodes of the largest class of a bucket meet only blocks of the rest,
    so that a bucket of copies costs as much as it has nodes.
    """
    most, rest = (F.ceil(x / BLOCK).cast("int") for x in (F.col("top.size"), F.col("n") - F.col("top.size")))
    rows = open_.where(F.col("n") > SMALL_BUCKET).select("bucket", "node", "class", (F.col("class") == F.col("top.class")).alias("in_top"), most.alias("most"), rest.alias("rest"))
    place = F.when(F.col("in_top"), F.pmod(F.xxhash64("node"), F.col("most"))).otherwise(F.col("most") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    others = F.sequence(F.when(F.col("in_top"), F.col("most")).otherwise(F.lit(0)), F.col("most") + F.col("rest") - 1)
    rows = rows.select("bucket", "node", "class", place.alias("block"), F.explode(others).alias("other"))
    return rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "class", "block")


def shared_weight(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Sums of the smaller weights of all pairs of bags (ids, tf, weight of one occurrence), by products of dense slices."""

    def spread(bags: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # The k-th occurrence of an id is a column of its own: a minimum is then a product.
        tf = np.concatenate([x[1] for x in bags]).astype(np.int64)
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        keys = mix(np.repeat(np.concatenate([x[0] for x in bags]), tf) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.repeat(np.arange(len(bags)), [int(x[1].sum()) for x in bags]), keys, np.repeat(np.concatenate([x[2] for x in bags]), tf)

    (a, keys_a, w), (b, keys_b, _) = spread(left), spread(right)
    common = np.intersect1d(keys_a, keys_b)
    out = np.zeros((len(left), len(right)))
    sides = []
    for of, keys, weight in ((a, keys_a, w), (b, keys_b, np.ones(len(keys_b), np.float32))):
        at = np.searchsorted(common, keys)
        hit = np.flatnonzero((at < len(common)) & (common[np.minimum(at, len(common) - 1)] == keys)) if len(common) else np.zeros(0, np.int64)
        hit = hit[np.argsort(at[hit], kind="stable")]
        sides.append((of[hit], at[hit], weight[hit]))
    for first in range(0, len(common), COLUMNS):
        dense = []
        for (of, at, weight), n in zip(sides, out.shape, strict=True):
            cut = slice(*np.searchsorted(at, (first, first + COLUMNS)))
            part = np.zeros((n, min(COLUMNS, len(common) - first)), np.float32)
            part[of[cut], at[cut] - first] = weight[cut]
            dense.append(part)
        out += dense[0] @ dense[1].T
    return out


def verify_blocks(blocks: DataFrame, banded: DataFrame, sets: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """A link (u, v) for each two classes with a pair at threshold or above in a pair of blocks.

    All pairs of different classes are compared, each in the first bucket it
    shares.  Products in single precision leave out what is clearly below;
    the rest is computed as in verify().
    """
    held = blocks.sparkSession.sparkContext.broadcast(idf)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        idf, (bucket, i, j) = held.value, (x.as_py() for x in key)
        rows = rows.sort_by("node")
        node, kind, block = (np.array(rows[c].to_pylist()) for c in ("node", "class", "block"))
        bands = np.array(rows["bands"].to_pylist())
        u, v = np.flatnonzero(block == j), np.flatnonzero(block == i)
        ask = kind[u][:, None] != kind[v][None, :]
        if i == j:
            ask &= u[:, None] < v[None, :]
        if ask.any():
            for k in range(int(np.flatnonzero(bands[0] == bucket)[0])):
                ask &= bands[u, k][:, None] != bands[v, k][None, :]
        links: list[tuple[str, str]] = []
        if ask.any():
            bags = []
            for x, t in zip(rows["ids"], rows["tf"], strict=True):
                ids, tf = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(t.as_py(), "<u4")
                bags.append((ids, tf, weigh(ids, np.ones(len(ids)), idf), weigh(ids, tf, idf)))
            total = np.array([x[3].sum(dtype=float) for x in bags])
            both = shared_weight([bags[k] for k in u], [bags[k] for k in v])
            alike = both / np.maximum(total[u][:, None] + total[v][None, :] - both, 1e-12)
            near = np.argwhere(ask & (alike >= threshold - 1e-4))
            met = set()
            for a, b in near[np.argsort(-alike[near[:, 0], near[:, 1]], kind="stable")]:
                a, b = u[a], v[b]
                pair = frozenset((kind[a], kind[b]))
                if pair not in met and weighted_jaccard(bags[a][0], bags[a][3], bags[b][0], bags[b][3]) >= threshold - 1e-9:
                    met.add(pair)
                    links.append((str(min(node[a], node[b])), str(max(node[a], node[b]))))
        return pa.table({"u": pa.array([x for x, _ in links], pa.string()), "v": pa.array([x for _, x in links], pa.string())})

    rows = blocks.join(banded, "node").join(sets.select("node", "ids", "tf"), "node")
    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "u string, v string")


def node_key(text: Column) -> Column:
    a, b = key128(F.coalesce(text, F.lit("")))
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def bags(texts: DataFrame) -> DataFrame:
    """(node, text) -> (node, ids, tf): the sorted ids (hashes of 52 bits) and term frequencies of the shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tfs = [], []
            for c in chunks(batch.column(1)):
                of, hashes, tf = shingles(c)
                cuts = np.searchsorted(of, np.arange(c.n + 1))
                hashes, tf = hashes.astype("<u8"), tf.astype("<u4")
                for a, b in zip(cuts, cuts[1:], strict=False):
                    ids.append(hashes[a:b].tobytes())
                    tfs.append(tf[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["node", "ids", "tf"])

    return texts.select("node", "text").mapInArrow(run, "node string, ids binary, tf binary")


def weighted_jaccard(ids_a: np.ndarray, w_a: np.ndarray, ids_b: np.ndarray, w_b: np.ndarray) -> float:
    """Sum of the smaller weights over sum of the larger; ids sorted."""
    _, x, y = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    both = np.minimum(w_a[x], w_b[y]).sum(dtype=float)
    every = w_a.sum(dtype=float) + w_b.sum(dtype=float) - both
    return both / every if every else 0.0


def verify(pairs: DataFrame, sets: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity is at least threshold."""
    held = pairs.sparkSession.sparkContext.broadcast(idf)
    joined = (
        pairs.join(sets.select(F.col("node").alias("u"), F.col("ids").alias("ids_u"), F.col("tf").alias("tf_u")), "u")
        .join(sets.select(F.col("node").alias("v"), F.col("ids").alias("ids_v"), F.col("tf").alias("tf_v")), "v")
        .select("u", "v", "ids_u", "tf_u", "ids_v", "tf_v")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            keep = []
            for a, ta, b, tb in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                a, b = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                wa, wb = weigh(a, np.frombuffer(ta.as_py(), "<u4"), idf), weigh(b, np.frombuffer(tb.as_py(), "<u4"), idf)
                keep.append(weighted_jaccard(a, wa, b, wb) >= threshold - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "u string, v string")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Classes of near duplicates.

    Returns (nodes, documents).  nodes: node (a distinct text), rep (its
    smallest id), n_copies, class_id (the smallest id in its class), kept
    (true for one node of a class).  documents: id, node, one row for each
    row of docs.

    Texts that are equal byte for byte are one class; a null text counts as
    an empty one.  Texts without words have no other duplicates.  Rows that
    repeat are copies.  Null ids come after all others; a class of null ids
    alone has a null class_id.  Ties are settled by node key.  An empty table
    gives empty results.  Columns other than the two named are not read.
    """
    idf = idf_table(docs, text_col)
    signed = materialise(signatures(docs, id_col, text_col, idf), "signatures")
    nodes = materialise(signed.groupBy("node").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")), "nodes")
    members = _members(nodes)
    involved = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.select(node_key(F.col(text_col)).alias("node"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(involved, "node")
    texts = texts.where(F.col("id").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    sets = materialise(bags(texts), "bags")

    tried = materialise(_stars(members), "pairs")
    classes = components(verify(tried, sets, idf, threshold))

    def merge(more: DataFrame, found: dict) -> None:
        nonlocal classes
        if found["n"]:
            classes = merged(classes, more)

    def link(pairs: DataFrame) -> None:
        """Verify pairs that were not tried before, and merge the classes they link."""
        nonlocal tried
        new, asked = materialise_counted(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs", n=F.count(F.lit(1)))
        if asked["n"]:
            tried = tried.unionByName(new)
            merge(*materialise_counted(verify(new, sets, idf, threshold), "links", n=F.count(F.lit(1))))

    open_, left = _open(members, classes)
    if left["large"]:
        crowded = open_.where(F.col("n") > SMALL_BUCKET).select("node").distinct()
        banded = materialise(deep_signatures(sets.join(crowded, "node"), idf), "signatures")
        deep = _members(banded)
        link(_across(open_).unionByName(_stars(deep)))
        open_, left = _open(deep, classes)
        if left["all"]:
            link(_across(open_).unionByName(_class_stars(open_)) if left["large"] else _across(open_))
        if left["large"]:
            open_, left = _open(open_.where(F.col("n") > SMALL_BUCKET), classes)
        if left["large"]:
            merge(*materialise_counted(verify_blocks(_blocks(open_), banded, sets, idf, threshold), "links", n=F.count(F.lit(1))))
    elif left["all"]:
        link(_across(open_))
    placed = nodes.select("node", "rep", "n_copies").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    first = placed.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("first"))
    out = placed.join(first, "class").select("node", "rep", "n_copies", F.col("first.rep").alias("class_id"), (F.col("node") == F.col("first.node")).alias("kept"))
    return out, signed.select("id", "node")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that represent their class: the one with the smallest id, once; all columns.

    Of rows that repeat an id and a text one stays.  Null ids come last, null
    texts are empty ones, and an empty table stays empty; columns pass
    through, whatever their names.
    """
    nodes, _ = near_duplicates(docs, id_col, text_col, threshold)
    kept = materialise(nodes.where("kept").select(F.col("node").alias("key"), F.col("rep").alias("rep")), "kept")
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), node_key(F.col(text_col)).alias("key"), F.col(id_col).alias("id"))
    one = rows.join(kept, "key").where(F.col("id").eqNullSafe(F.col("rep"))).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("place = 1")
    return one.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, documents = near_duplicates(table(spark, sf_dir, "documents"))
    return documents.join(nodes, "node").select(F.col("id").alias("doc_id"), "class_id", (F.col("kept") & F.col("id").eqNullSafe(F.col("rep"))).alias("kept"))
