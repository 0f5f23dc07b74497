"""Vectorised words, word hashes and shingles over Arrow string batches.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. All UTF-8 continuation bytes are above 0x7F, so
byte positions and code points give the same words. Hashes are 64 bits wide; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, 1 << 20)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _POW.update(n=size, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POW["up"], _POW["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose texts hold about ``limit`` bytes, so that working arrays stay bounded."""
    texts = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_buffer(texts)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """Words of one slice. ``starts``, ``ends``: byte positions; ``doc``: row of each word; ``first``: word index where each row begins."""

    def __init__(self, column: pa.Array, lower: bool):
        data, self.offsets = text_buffer(column)
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = ~SPACE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[1:], after[:-1] = word[:-1], word[1:]
            before[0] = after[-1] = False
            edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            before[edges] = False
            after[edges - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(column)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one prefix sum of a polynomial modulo 2**64."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that begin at each place; the last ``width - 1`` places are missing."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += words[k : k + n]
    return mix(out)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles for each row, words with A-Z lowered; fewer words: the sequence as one."""
    w = Words(column, lower=True)
    h = w.hashes()
    all_windows = window_hashes(h, width)
    out = []
    for i in range(len(column)):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= width:
            out.append(np.unique(all_windows[a : b - width + 1]))
        elif b > a:
            out.append(mix(window_hashes(h[a:b], int(b - a)) + np.uint64(int(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
