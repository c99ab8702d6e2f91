"""Words and word shingles of whole texts as hashed numpy arrays, a slice of an Arrow batch at a time.

Words are maximal runs of anything but the six ASCII white-space characters, after lower-casing A-Z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh64_intdigest

SLICE_BYTES = 4 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_M4 = np.uint64(0xD1342543DE82EF95)
#: Steps of eight bytes that a word is hashed in, and masks of the first 0 to 8 of eight bytes.
LANES = 8
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: What the hash of a word of each length begins with.
_BY_LENGTH = mix(np.arange(8 * LANES + 1, dtype=np.uint64) * _M4 + _M1)


def release() -> None:
    """Gives memory that is free but held back to the system, since idle workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text (one row at least), so that memory is bounded by
    ``size`` and the longest text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        release()
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.take(pa.array(np.arange(a, b)))  # a copy: Arrow's string kernels misread sliced offsets
    release()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one array, and the offset of each text's first word. Null counts as empty."""
    low = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(low)
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), before[ends]


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes a step for all words at once; words beyond ``LANES`` steps by xxHash, one by one."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.empty(0, np.uint64)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.zeros(at[-1] - at[0] + 8, np.uint8)
    raw[:-8] = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else 0
    at = at - at[0]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    start, n = at[:-1], np.diff(at)
    out = mix((_BY_LENGTH[np.minimum(n, len(_BY_LENGTH) - 1)] ^ (eight[start] & _FIRST[np.minimum(n, 8)])) * _M4)
    live = np.flatnonzero((n > 8) & (n <= 8 * LANES))
    for lane in range(1, LANES):
        if not len(live):
            break
        left = n[live] - 8 * lane
        out[live] = mix((out[live] ^ (eight[start[live] + 8 * lane] & _FIRST[np.minimum(left, 8)])) * _M4)
        live = live[left > 8]
    for i in np.flatnonzero(n > 8 * LANES).tolist():
        out[i] = xxh64_intdigest(raw[at[i] : at[i + 1]])
    return out


def shingle_hashes(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``width`` words each; with fewer words the whole sequence is
    one shingle; a text without words has none."""
    words, ends = split_words(texts)
    h = hash_words(words)
    acc = h.copy()
    for k in range(1, width):
        acc = mix(acc * _M1 + np.uint64(k))
        acc[: max(0, len(h) - k)] += h[k:]
    rolled = mix(acc)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            one = h[a : a + 1]
            for k in range(1, b - a):
                one = mix(one * _M1 + np.uint64(k)) + h[a + k]
            yield mix(one ^ np.uint64(b - a))
        else:
            yield rolled[:0]
