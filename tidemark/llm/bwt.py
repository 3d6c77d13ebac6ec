"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many texts.

Each round inserts one more symbol of every text, from the right: the suffixes of
length j of all texts find their places among the shorter ones by the ranks of
their first symbols in the transform so far, and the lengths of common prefixes with both
neighbours follow from a range minimum. The transform and the common prefixes are
kept in two sequential files, which each round reads once and writes anew.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first .. last]) for ranges of at least one element."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out, table = np.empty(len(first), values.dtype), values
    for j in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == j)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << j) + 1])
        table = np.minimum(table[: -(1 << j) or None], table[1 << j :])
    return out


class _File:
    """A sequential file of one array, read and written from its begin."""

    def __init__(self, path: Path, kind):
        self.kind, self.file, self.n = kind, path.open("w+b", buffering=0), 0

    def write(self, values: np.ndarray) -> None:
        self.file.seek(0)
        data = memoryview(values).cast("B")
        while len(data):
            data = data[self.file.write(data) :]
        self.n = len(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        out = np.empty(self.n, self.kind)
        data = memoryview(out).cast("B")
        while len(data):
            data = data[self.file.readinto(data) :]
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def build(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0: a text's begin) and common prefix with the suffix before, over all suffixes, the empty ones first.

    symbols: all texts one after the other, small numbers from 1 on.
    """
    m, ends = len(lengths), np.cumsum(lengths)
    padded = np.r_[np.zeros(1, symbols.dtype), symbols]
    # the j-th symbol from a text's end, 0 beyond its begin
    symbol = lambda text, j: np.where(lengths[text] > j, padded[np.maximum(ends[text] - j, 0)], 0).astype(symbols.dtype)
    small = np.uint8 if lengths.max(initial=0) < 255 else np.uint32
    with tempfile.TemporaryDirectory() as folder, _File(Path(folder, "transform"), symbols.dtype) as transform, _File(Path(folder, "common"), small) as prefixes:
        texts = np.arange(m)
        transform.write(symbol(texts, 0))
        prefixes.write(np.zeros(m, small))
        texts = texts[lengths > 0]
        place = texts  # of each text's latest suffix
        owner = np.empty(m + len(symbols), np.int32)
        for j in range(1, int(lengths.max(initial=0)) + 1):
            bwt, common = transform.read(), prefixes.read()
            n = len(bwt)
            order = np.argsort(bwt, kind="stable")
            zeros = n - np.count_nonzero(bwt)
            owner[place] = texts
            latest = np.zeros(n, bool)
            latest[place] = True
            r = np.flatnonzero(latest[order])  # ranks of the latest suffixes' first symbols to come
            place = order[r]
            texts = owner[place]
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
            own = bwt[place]
            same_before = (r > 0) & (bwt[before] == own)
            same_after = (r < n - 1) & (bwt[after] == own)
            to_before, to_after = np.zeros(len(r), small), np.zeros(len(r), small)
            at = np.flatnonzero(same_before)
            to_before[at] = 1 + _range_min(common, before[at] + 1, place[at])
            at = np.flatnonzero(same_after)
            to_after[at] = 1 + _range_min(common, place[at] + 1, after[at])
            place = m + r - zeros
            new = np.zeros(n + len(place), bool)
            new[place] = True
            old = ~new
            longer, shared = np.empty(len(new), symbols.dtype), np.empty(len(new), small)
            longer[old], shared[old] = bwt, common
            inside = place + 1 < len(new)
            shared[place[inside] + 1] = to_after[inside]
            longer[place], shared[place] = symbol(texts, j), to_before
            transform.write(longer)
            prefixes.write(shared)
            going = lengths[texts] > j
            texts, place = texts[going], place[going]
        return transform.read(), prefixes.read()


def suffix_classes(symbols: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, offset and class of every suffix of at least depth symbols; a class has the suffixes that agree in their first depth symbols."""
    bwt, common = build(symbols, lengths)
    m = len(lengths)
    number = np.cumsum(common < depth)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = m + np.arange(len(bwt)) - (len(bwt) - np.count_nonzero(bwt))
    texts = np.arange(m)
    place = texts
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for j in range(int(lengths.max(initial=0)) + 1):
        if j:
            place = step[place]
        if j >= depth:
            out.append((texts, lengths[texts] - j, number[place]))
        going = lengths[texts] > j
        texts, place = texts[going], place[going]
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
