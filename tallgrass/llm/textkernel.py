"""Vectorised byte and word kernels over the string buffers of Arrow batches.

Texts stay in Arrow's UTF-8 buffer; numpy views it without a copy. Hashes are
polynomials over per-byte random values modulo 2**64, taken from prefix sums,
then mixed; a substring's hash costs a few operations whatever its length.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once; temporaries take some 60 times as much.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Per-byte values as is, and with A-Z taken as a-z.
EXACT, FOLDED = _BYTE, _BYTE[_LOWER]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A membership table over bytes; ranges include both ends."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z, and of [^\x20\x09-\x0D].
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NON_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))

_powers = np.empty(0, dtype=U64)
_inverses = np.empty(0, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, PIECE + 4096)
        for_all = np.full(size, _BASE, dtype=U64)
        for_all[0] = 1
        _powers = np.multiply.accumulate(for_all)
        for_all[1:] = U64(_INVERSE)
        _inverses = np.multiply.accumulate(for_all)
    return _powers, _inverses


def prefix_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums from which substring_hashes takes the hash of any part of data."""
    base, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(values[data] * base[: len(data)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of data[starts:ends]."""
    _, inverse = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def string_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has length 0."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None or len(array) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(array) + 1, dtype=np.int64)
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_groups(offsets: np.ndarray, limit: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes together; a longer row comes alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, values: np.ndarray = FOLDED):
    """Words of each text of a group of rows.

    data holds the texts back to back, offsets their bounds in it (from 0).
    Returns (starts, ends, hashes, first): byte bounds and hash of each word,
    and for each row the index of its first word (one more entry at the end).
    A word never crosses texts. Pieces end between words, so temporaries stay
    bounded for texts of any length (a single longer word excepted).
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=U64), np.zeros(len(offsets), dtype=np.int64)
    inside = is_word[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    bounds = offsets[(offsets > 0) & (offsets < n)]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), dtype=U64)
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(ends, starts[low] + PIECE, side="right"))
        high = max(high, low + 1)
        a, b = int(starts[low]), int(ends[high - 1])
        prefix = prefix_hashes(data[a:b], values)
        s, e = starts[low:high] - a, ends[low:high] - a
        hashes[low:high] = substring_hashes(prefix, s, e) + (e - s).astype(U64)
        low = high
    return starts, ends, mix(hashes), np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, one for each start (len(words) - n + 1 of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    out = words[:count] + U64(n)
    for k in range(1, n):
        out *= U64(0xFF51AFD7ED558CCD)
        out += words[k : k + count]
    return mix(out)


def merge_intervals(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Union of half-open intervals for each key: (keys, starts, ends), sorted; touching intervals join."""
    if len(keys) == 0:
        return keys, starts, ends
    order = np.lexsort((starts, keys))
    k, s, e = keys[order], starts[order], ends[order]
    shift = np.concatenate(([0], np.cumsum(k[1:] != k[:-1]))).astype(np.int64)
    span = int(e.max()) + 2
    reach = np.maximum.accumulate(e + shift * span)
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (s + shift * span)[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(k)) - 1
    return k[heads], s[heads], reach[tails] - shift[tails] * span


def give_back() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def returning(work: Callable) -> Callable:
    """A batch function that gives freed memory back when its partition is done: workers live on between tasks."""

    @wraps(work)
    def run(batches):
        yield from work(batches)
        give_back()

    return run


def arrow_strings(values: list) -> pa.Array:
    return pa.array(values, type=pa.string())
