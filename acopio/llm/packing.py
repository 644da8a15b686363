"""Best-fit packing of token sequences (list item 4), bulk-synchronous.

Every document becomes pieces of at most ``seq_len`` tokens.  The pieces are
range-sorted by length and ranked in their length class on the executors; a
class is then a run of ranks, and equal gaps are runs of sequence numbers.  So
what is matched is a table of runs, whose size depends on ``seq_len`` and not
on the corpus.

Packing goes in supersteps, from the long pieces down, one class of lengths
(``seq_len / 2`` and more, a quarter and more, ...) after the other:

1. pieces of the class and gaps that hold one are dealt to ranges of size;
2. every range is swept on its own, the longest piece first, each taking the
   smallest gap that is large enough (its successor); pieces that want the same
   gap are told apart by rank, and what is left of a gap takes part again;
3. moves, changed gaps and pieces left over are written, and the next superstep
   reads them: first with no new sequence, then with the runs that are left in
   one range, which finds the gaps that lie in other ranges and opens what it
   still needs.

Gaps too small for a class wait for the next.  A move is (length, ranks
from-to, sequences from-to, offset); executors look their pieces up by
(length, rank).
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, materialise_counted, table

SEQ_LEN = 2048
END_ID = 0
_encoders: dict = {}


def encoder(path: str):
    """A byte-level BPE encoder for a tokenizers JSON file, kept for each process.

    The vocabulary and merge order come from the file.  The merging is done by
    tiktoken, which gives the ids of the tokenizers library (tested) at a
    third of its CPU time.  Texts with a special token in them, and those
    that tiktoken's pattern refuses (a million blanks), go to the tokenizers
    library itself.
    """
    if path not in _encoders:
        import tiktoken
        import tokenizers

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain_call = tokenizers.Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            if not any(x in text for x in special):
                try:
                    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")
                except ValueError:
                    pass
            return np.asarray(plain_call.encode(text, add_special_tokens=False).ids, "<u4")

        _encoders[path] = encode
    return _encoders[path]


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, and a shorter first one."""
    head = n % seq_len
    return ([(0, head)] if head else []) + [(k, seq_len) for k in range(head, n, seq_len)]


def tokenise(docs: DataFrame, id_col: str, text_col: str, path: str, seq_len: int, end_id: int, keep_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, pieces, starts, lengths, crcs, kept = [], [], [], [], [], []
            for row in range(batch.num_rows):
                ids = np.append(enc(batch.column(1)[row].as_py() or ""), np.array([end_id], "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), seq_len)):
                    part = ids[start : start + length]
                    rows.append(row)
                    pieces.append(k)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            cols += [pa.array(kept, pa.list_(pa.int32()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


def sweep(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], seq_len: int, first_new: int, new: int) -> tuple[list, list, list]:
    """One range: runs of pieces (length, first rank, how many) into runs of gaps (gap, first sequence, how many).

    Best fit, the longest first; at most ``new`` sequences are opened, from
    number first_new on.  Returns the moves (length, first rank, how many,
    first sequence, offset), the pieces left and the gaps left.
    """
    runs: dict[int, deque] = defaultdict(deque)  # gap -> runs (first sequence, how many)
    sizes: list[int] = []  # the gaps that have runs, sorted
    moves, left = [], []

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not runs[gap]:
                insort(sizes, gap)
            runs[gap].append((first, n))

    def fill(length: int, rank: int, need: int, gap: int, first: int, n: int) -> tuple[int, int]:
        """Put pieces into n sequences with this gap; how many, and the sequences used."""
        each = gap // length
        whole = min(n, need // each)
        for k in range(each if whole else 0):
            moves.append((length, rank + k * whole, whole, first, seq_len - gap + k * length))
        add(gap - each * length, first, whole)
        placed, used, rest = whole * each, whole, min(need - whole * each, each - 1)
        if rest and used < n:
            for k in range(rest):
                moves.append((length, rank + placed + k, 1, first + used, seq_len - gap + k * length))
            add(gap - rest * length, first + used, 1)
            placed, used = placed + rest, used + 1
        return placed, used

    for gap, first, n in sorted(gaps):
        add(gap, first, n)
    for length, rank, need in sorted(pieces, key=lambda x: (-x[0], x[1])):
        while need:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = runs[gap].popleft()
                if not runs[gap]:
                    sizes.pop(at)
                placed, used = fill(length, rank, need, gap, first, n)
                add(gap, first + used, n - used)
            elif new:
                n = min(new, -(-need // (seq_len // length)))
                placed, used = fill(length, rank, need, seq_len, first_new, n)
                first_new, new = first_new + used, new - used
            else:
                left.append((length, rank, need))
                break
            rank, need = rank + placed, need - placed
    return moves, left, [(gap, first, n) for gap in sizes for first, n in runs[gap]]


def plan(counts: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int]]:
    """The moves of serial best fit, longest first, over all pieces at once."""
    return sweep([(length, 0, n) for length, n in counts.items()], [], seq_len, 0, sum(counts.values()))[0]


_PIECE, _GAP, _MOVE = 0, 1, 2
_STATE = "kind int, size long, first long, n long, sequence long, offset long"
RANGES = 8


def superstep(state: DataFrame, low: int, high: int, seq_len: int, ranges: int, opens: bool, step: int) -> DataFrame:
    """Sweep the pieces of low < length <= high, in ranges that may open new sequences or not.

    state holds pieces (kind 0: size, first rank, n) and gaps (kind 1: size,
    first sequence, n); what comes back holds moves (kind 2) too.  Numbers of
    new sequences have the superstep and the range in their upper bits.
    """
    # Gaps above the class hold any of its pieces and are dealt out evenly.
    size = F.when(F.col("size") <= high, F.col("size")).otherwise(low + 1 + F.pmod(F.xxhash64("first", "size"), F.lit(high - low)))
    key = F.floor((size - low - 1) * ranges / (high - low)).cast("int")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = sorted(zip(*(rows[c].to_pylist() for c in ("kind", "size", "first", "n")), strict=True))
        pieces, gaps = ([r[1:] for r in rows if r[0] == kind] for kind in (_PIECE, _GAP))
        new = sum(p[2] for p in pieces) if opens else 0
        moves, left, gaps = sweep(pieces, gaps, seq_len, (step << 48) | (key[0].as_py() << 40), new)
        out = [(_PIECE, *p, None, None) for p in left] + [(_GAP, *g, None, None) for g in gaps] + [(_MOVE, *m) for m in moves]
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({c: pa.array(v, pa.int32() if c == "kind" else pa.int64()) for c, v in zip(("kind", "size", "first", "n", "sequence", "offset"), cols, strict=True)})

    return state.withColumn("range", key).groupBy("range").applyInArrow(run, _STATE)


def classes(seq_len: int) -> list[tuple[int, int]]:
    """(low, high] of the classes of length, from the longest down; the short pieces are one class."""
    out, high = [], seq_len
    while high:
        low = high // 2 if high > max(64, seq_len // 64) else 0
        out.append((low, high))
        high = low
    return out


def match(lengths: dict[int, int], spark: SparkSession, seq_len: int, ranges: int = RANGES) -> DataFrame:
    """The moves (length, rank, n, sequence, offset) of all pieces; lengths: how many of each length."""
    runs = [(_PIECE, length, 0, n, None, None) for length, n in sorted(lengths.items())]
    waiting, moves, step, gaps = spark.createDataFrame(runs, _STATE), None, 0, 0
    for low, high in classes(seq_len):
        if not any(low < length <= high for length in lengths):
            continue
        own = (F.col("size") > low) & ((F.col("kind") == _GAP) | (F.col("size") <= high))
        active, parts = waiting.where(own), min(ranges, high - low)
        # Pieces above half a sequence meet no gap: each opens a sequence, in its range.
        passes = [(parts, True)] if 2 * low >= seq_len else [(parts, False), (1, True)] if gaps else [(1, True)]
        for n, opens in passes:
            step += 1
            done, seen = materialise_counted(superstep(active, low, high, seq_len, n, opens, step), "superstep", left=F.count_if(F.col("kind") == _PIECE), gaps=F.count_if(F.col("kind") == _GAP))
            moved = done.where(F.col("kind") == _MOVE)
            moves = moved if moves is None else moves.unionByName(moved)
            active, gaps = done.where(F.col("kind") != _MOVE), max(gaps, seen["gaps"])
            if not seen["left"]:
                break
        waiting = waiting.where(~own).unionByName(active)
    if moves is None:
        moves = waiting
    return moves.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "sequence", "offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most seq_len tokens.

    A document is its ids and then end_id; only longer ones are cut.  Returns
    one row for each piece: id_col, piece, start, length, ids_crc32,
    sequence_id, offset, and ids if keep_ids.

    A null or empty text is end_id alone.  A null id is kept.  Rows that
    repeat an id or a text are documents of their own.  Ties of length are
    told apart by rank, which may differ between runs; the number of
    sequences does not.  An empty table gives no pieces.  Other columns are
    not read.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    # Written before the range sort, which reads its input twice.
    pieces = materialise(tokenise(docs, id_col, text_col, path, seq_len, end_id, keep_ids), "pieces")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            order = np.argsort(lengths, kind="stable")
            first = np.concatenate(([True], lengths[order][1:] != lengths[order][:-1])) if len(order) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            own = np.empty(len(order), np.int64)
            own[order] = np.arange(len(order)) - start
            own += seen[lengths]
            seen += np.bincount(lengths, minlength=seq_len + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(own)], names=[*names, "part", "rank"])

    sorted_pieces = pieces.repartitionByRange(n, F.col("length").desc(), "crc", "id", "piece")
    ranked = materialise(sorted_pieces.mapInArrow(rank, schema), "ranked")
    # Pieces are range-sorted by length: each class lies in neighbouring parts,
    # so there are at most parts + seq_len rows here.
    tally = sorted((r["length"], r["part"], r["n"]) for r in ranked.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for length, part, k in tally:
        before[length, part] = counts[length]
        counts[length] += k
    # The moves are runs too: some thousand, whatever the number of pieces.
    moves = match(counts, docs.sparkSession, seq_len).toPandas().sort_values(["length", "rank"]).to_numpy(np.int64)
    keys = (moves[:, 0] << 48) | moves[:, 1]
    at = np.array(sorted((length << 32) | part for length, part in before), np.int64)
    shift = np.array([before[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in at], np.int64)
    out = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *([pieces.schema["ids"]] if keep_ids else [])])
    held = docs.sparkSession.sparkContext.broadcast((keys, moves[:, 1], moves[:, 3], moves[:, 4], at, shift))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets, at, shift = held.value
        for batch in batches:
            length, part, rank = (batch.column(k).to_numpy() for k in ("length", "part", "rank"))
            whole = rank + shift[np.searchsorted(at, (length << 32) | part)] if len(rank) else rank
            move = np.searchsorted(keys, (length << 48) | whole, "right") - 1
            cols = [*batch.columns[:5], pa.array(sequences[move] + whole - ranks[move]), pa.array(offsets[move]), *([batch.column("ids")] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return ranked.mapInArrow(assign, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack(..., keep_ids=True)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
