"""Words, lines and word windows of whole Arrow batches as numpy arrays.

Everything works on the UTF-8 bytes of many documents at once.  A word or a
line is known by a 64-bit hash that mixes its bytes, eight at a time (xxh3
for long ones).  Batches are cut into chunks of a few hundred kilobytes, so
memory depends on the longest document and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK_BYTES = 1 << 19


LONG_SPAN = 64  # bytes from which a span is hashed on its own


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash; x may be changed."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Chunk:
    """Some consecutive documents: bytes, bounds, and what is found in them."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, first: int):
        self.buf, self.bounds, self.first = buf, bounds, first
        self.n = len(bounds) - 1
        self._eights: np.ndarray | None = None

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each document has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each maximal run of inside bytes."""
        if not len(self.buf):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.empty(len(inside) + 1, bool)
        edge[0], edge[1:] = False, inside
        cuts = self.bounds[(self.bounds > 0) & (self.bounds < len(inside))]
        before = edge[:-1].copy()
        before[cuts] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[:-1], after[-1] = inside[1:], False
        after[cuts - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.bounds, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line of each document; empty too."""
        breaks = np.flatnonzero(self.buf == 10)
        of = np.searchsorted(self.bounds, breaks, "right") - 1
        starts = np.concatenate((self.bounds[:-1], breaks + 1))
        ends = np.concatenate((breaks, self.bounds[1:]))
        docs = np.concatenate((np.arange(self.n), of))
        order = np.lexsort((starts, docs))
        ends_of = np.concatenate((of, np.arange(self.n)))
        return starts[order], ends[np.lexsort((ends, ends_of))], docs[order]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        size = ends - starts
        out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        if self._eights is None:  # the eight bytes from each place on, as one number
            held = np.concatenate((self.buf, np.zeros(15, np.uint8)))
            self._eights = np.empty(len(self.buf) + 8, np.uint64)
            for k in range(8):
                part = held[k : k + (len(held) - k) // 8 * 8].view("<u8")
                self._eights[k::8] = part[: len(self._eights[k::8])]
        active = np.flatnonzero(size <= LONG_SPAN)
        at, left = starts[active], size[active]
        while len(active):
            value = self._eights[at] & _MASKS[np.minimum(left, 8)]
            out[active] = mix(out[active] ^ value * np.uint64(0xC2B2AE3D27D4EB4F))
            more = left > 8
            active, at, left = active[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > LONG_SPAN):
            out[k] = xxhash.xxh3_64_intdigest(self.buf[starts[k] : ends[k]])
        return out


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """The documents of a string array, nulls as empty texts, in chunks."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + 4000, len(texts))
        yield Chunk(whole[offsets[at] : offsets[to]], (offsets[at : to + 1] - offsets[at]).astype(np.int64), at)
        at = to


def windows(hashes: np.ndarray, docs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each window of size words inside one document, and its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[size - 1 :])
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    return mix(total[at]), at


def doc_keys(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Document and hash in one number that sorts by document (up to 4,096 in a chunk)."""
    return (docs.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12))


def code_points(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a chunk, and the bounds of its documents in them."""
    points = np.frombuffer(c.buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    total = np.concatenate(([0], np.cumsum((c.buf & 0xC0) != 0x80)))
    return points, total[c.bounds]


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size code points; its last size - 1 places are missing."""
    n = max(len(points) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += (points[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    total ^= total >> np.uint64(29)
    return total


def padded(points: np.ndarray, bounds: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """The points with a mark before and after each document, and each place's document."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out, own = np.full(len(points) + len(bounds), mark, np.uint32), np.zeros(len(points) + len(bounds), np.int64)
    where = np.arange(len(points)) + of + 1
    out[where], own[where] = points, of
    return out, own


def edge_grams(text: np.ndarray, own: np.ndarray, edge: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the runs of size places that have an edge at one end at most, and none inside."""
    h = grams(text, size)
    n = len(h)
    inner = np.ones(n, bool)
    for k in range(1, size - 1):
        inner &= text[k : k + n] != edge
    first, last = text[:n] != edge, text[size - 1 : size - 1 + n] != edge
    at = np.flatnonzero(inner & (first | last))
    return np.where(text[at] != edge, own[at], own[np.minimum(at + 1, len(own) - 1)]), h[at]
