"""Vectorised Rabin-Karp hashing of texts: bytes, words and windows of words.

All functions work on one bounded batch of documents inside a task. A batch is
one byte buffer plus document offsets, as Arrow lays out a string column, so no
per-word Python objects are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the two independent hash lanes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Symbols of a buffer that range_hash takes at a time.
HELD = 1 << 17
#: The white space that ends a word: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: A table for each base, as long as was needed so far.
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; sizes are rounded up so that tables seldom grow, and a shorter one isn't kept beside a longer one."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(1 << 16, 1 << int(n - 1).bit_length()), base, dtype=np.uint64)
        known[0] = 1
        _POWERS[base] = np.cumprod(known, dtype=np.uint64, out=known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs get unrelated outputs."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers in order, by one sort."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


def lowered(buf: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return buf + (((buf - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))


def eights(buf: np.ndarray) -> np.ndarray:
    """buf[i:i + 8] as a little-endian number for every i, zeros behind its end: a view, so only what is taken of it is made."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def flat(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[offsets[0] : offsets[-1]]
    return (lowered(buf) if lower else buf), offsets - offsets[0]


def range_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Polynomial hash of buf[start:end] for every range; buf holds bytes or mixed hashes."""
    if len(buf) <= HELD or (start[1:] < start[:-1]).any():
        return hash_of(prefix_hashes(buf, lane), start, end, lane)
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):  # ranges in order: a part of buf at a time, so that no array is as long as it
        low, j = start[i], int(np.searchsorted(start, start[i] + HELD))
        out[i:j] = hash_of(prefix_hashes(buf[low : end[i:j].max()], lane), start[i:j] - low, end[i:j] - low, lane)
        i = j
    return out


def prefix_hashes(buf: np.ndarray, lane: int = 0) -> np.ndarray:
    """What hash_of needs of buf, for several sets of ranges."""
    n = len(buf)
    h = np.zeros(n + 1, dtype=np.uint64)
    if n:
        # 1 is added so that leading zero symbols count.
        x = buf.astype(np.uint64)
        x += np.uint64(1)
        x *= powers(BASES[lane], n)
        np.cumsum(x, out=h[1:])
    return h


def hash_of(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """range_hash of every range, from prefix_hashes."""
    inverse = pow(BASES[lane], -1, 1 << 64)
    length = (end - start).astype(np.uint64)
    return mix((prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start] + length * np.uint64(0xA24BAED4963EE407))


def fixed_hash(buf: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """range_hash of buf[i:i + length] for every i, by slices."""
    base, n = BASES[lane], len(buf)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=h[1:])
    x = h[length:] - h[:-length]
    x *= powers(pow(base, -1, 1 << 64), n + 1)[: len(x)]
    x += np.uint64(length * 0xA24BAED4963EE407 & (1 << 64) - 1)
    return mix(x)


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and document row of every word, by default ``[^\\x20\\x09-\\x0D]+``, in order."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = is_space[buf]
    inside = ~space
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def windows(hashes: np.ndarray, doc: np.ndarray, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First positions of all k-runs inside one document, and their hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, range_hash(hashes, at, at + k, lane)


def covered(n: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in some interval [start, start + length)."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, n), -1)
    return np.cumsum(step[:-1]) > 0
