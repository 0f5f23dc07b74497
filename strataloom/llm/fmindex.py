"""FM-index over the words of many documents: backward search by ranks in a wavelet tree, places by sampled suffix positions.

The text of an index is the words of its documents as numbers, each document followed by a separator. Suffixes are sorted by
several words at once and then only where they still tie; separators differ, so no order depends on what follows a document.
The wavelet tree stands level by level, the highest bit of the symbols first, zeros before ones. Ranks are counted from the
bits of a level when an index is opened, so only bits, symbol counts and samples are stored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SAMPLE = 16


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in their order. 0 is the separator; separators order by place. ``symbols``: 1 + the largest symbol."""
    n = len(text)
    ends = text == 0
    n_ends = int(ends.sum())
    first = text.astype(np.int64) + n_ends
    first[ends] = np.arange(1, n_ends + 1)
    bits = int(symbols + n_ends).bit_length()
    per = max(1, 62 // bits)
    key = np.zeros(n + per, np.int64)
    key[:n] = first
    whole = key[:n].copy()
    for j in range(1, per):
        whole <<= bits
        whole |= key[j : j + n]
    order = np.argsort(whole)
    new = np.ones(n, bool)
    new[1:] = np.diff(whole[order]) != 0
    rank, depth = np.zeros(n, np.int64), per
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n))) + 1
    bits = int(n + 1).bit_length()
    per = 62 // bits
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        key = rank[at]
        for j in range(1, per):
            later = at + j * depth
            key <<= bits
            key |= np.where(later < n, rank[np.minimum(later, n - 1)], 0)
        place = np.argsort(key)
        key = key[place]
        order[slots] = at[place]
        new = np.ones(len(slots), bool)
        new[1:] = np.diff(key) != 0
        starts = np.flatnonzero(new)
        rank[order[slots]] = np.repeat(slots[starts], np.diff(np.append(starts, len(slots)))) + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots, depth = slots[tied], depth * per
    return order


class WaveletTree:
    """Bits of the levels of a sequence of symbols, with ranks."""

    def __init__(self, n: int, levels: int, words: np.ndarray, zeros: np.ndarray):
        self.n, self.levels, self.words, self.zeros = n, levels, words, zeros
        self.counts = np.zeros((levels, words.shape[1] + 1), np.int64)
        np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64, out=self.counts[:, 1:])

    @classmethod
    def build(cls, sequence: np.ndarray, symbols: int) -> WaveletTree:
        n, levels = len(sequence), max(1, int(symbols - 1).bit_length())
        width = n // 64 + 1
        words, zeros = np.zeros((levels, width), np.uint64), np.zeros(levels, np.int64)
        sequence = sequence.astype(np.uint16 if levels <= 16 else np.uint32)
        for level in range(levels):
            ones = (sequence >> (levels - 1 - level)) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words[level].view(np.uint8)[: len(packed)] = packed
            rest = ~ones
            zeros[level] = int(rest.sum())
            if level + 1 < levels:
                sequence = np.concatenate([sequence[rest], sequence[ones]])
        return cls(n, levels, words, zeros)

    def _ones(self, level: int, place: np.ndarray) -> np.ndarray:
        word, low = place >> 6, (place & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the occurrences of ``symbol`` before ``place`` end in the order below the last level; less its value at 0, the rank."""
        for level in range(self.levels):
            ones = self._ones(level, place)
            bit = (symbol >> (self.levels - 1 - level)) & 1
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return place

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its place below the last level)."""
        symbol = np.zeros(len(place), np.int64)
        for level in range(self.levels):
            ones = self._ones(level, place)
            bit = ((self.words[level][place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            symbol = symbol << 1 | bit
            place = np.where(bit == 1, self.zeros[level] + ones, place - ones)
        return symbol, place


class FMIndex:
    """Index of documents' words; ``starts`` has the place of each document's first word, and at the end the text's length."""

    def __init__(self, spellings: pa.Array, before: np.ndarray, tree: WaveletTree, marks: np.ndarray, samples: np.ndarray, starts: np.ndarray):
        self.spellings, self.before, self.tree, self.marks, self.samples, self.starts = spellings, before, tree, marks, samples, starts
        self.marked = np.append(0, np.cumsum(np.bitwise_count(marks), dtype=np.int64))

    @classmethod
    def build(cls, words: np.ndarray, sizes: np.ndarray, spellings: pa.Array, sample: int = SAMPLE) -> FMIndex:
        """From the number of each word, the words of each document, and the spellings by number."""
        symbols, starts = len(spellings) + 1, np.append(0, np.cumsum(sizes + 1))
        text = np.zeros(int(starts[-1]), np.int32)
        held = np.ones(len(text), bool)
        held[starts[1:] - 1] = False
        text[held] = words + 1
        order = suffix_order(text, symbols)
        counts = np.bincount(text, minlength=symbols)
        tree = WaveletTree.build(text[order - 1], symbols)
        marked = order % sample == 0
        marked |= ~held[order - 1]  # documents begin behind separators: no step ever crosses one
        packed = np.packbits(marked, bitorder="little")
        marks = np.zeros(len(text) // 64 + 1, np.uint64)
        marks.view(np.uint8)[: len(packed)] = packed
        return cls(spellings, np.append(0, np.cumsum(counts)), tree, marks, order[marked].astype(np.uint32), starts)

    def to_bytes(self) -> bytes:
        offsets, spelt = self.spellings.buffers()[1], self.spellings.buffers()[2]
        n = len(self.spellings)
        offsets = np.frombuffer(offsets, np.int64)[self.spellings.offset : self.spellings.offset + n + 1]
        spelt = b"" if spelt is None else spelt.to_pybytes()[offsets[0] : offsets[-1]]
        parts = [np.diff(offsets).astype(np.uint32).tobytes(), spelt, self.before.astype(np.int64).tobytes(), self.tree.words.tobytes(), self.tree.zeros.tobytes(), self.marks.tobytes(), self.samples.tobytes(), self.starts.astype(np.int64).tobytes()]
        return struct.pack("<3Q8Q", n, self.tree.n, self.tree.levels, *map(len, parts)) + b"".join(x + b"\0" * (-len(x) % 8) for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        n, length, levels, *sizes = struct.unpack_from("<3Q8Q", data)
        at, parts = 88, []
        for size in sizes:
            parts.append(memoryview(data)[at : at + size])
            at += size + -size % 8
        array = lambda k, kind: np.frombuffer(parts[k], kind)
        offsets = np.append(0, np.cumsum(array(0, np.uint32), dtype=np.int64))
        spellings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(bytes(parts[1]))])
        tree = WaveletTree(length, levels, array(3, np.uint64).reshape(levels, -1), array(4, np.int64))
        return cls(spellings, array(2, np.int64), tree, array(5, np.uint64), array(6, np.uint32), array(7, np.int64))

    def symbols(self, words: pa.Array) -> np.ndarray:
        """The symbol of each word, 0 for words that the index does not hold."""
        return pc.index_in(words, value_set=self.spellings).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def search(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of the suffixes that begin with each phrase ``symbols[start : start + size]``; sizes are at least 1."""
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        known = np.append(0, np.cumsum(symbols == 0))
        alive = np.flatnonzero(known[starts + sizes] == known[starts])
        last = symbols[starts[alive] + sizes[alive] - 1]
        low[alive], high[alive] = self.before[last], self.before[last + 1]
        step = 1
        while True:
            alive = alive[(sizes[alive] > step) & (high[alive] > low[alive])]
            if not len(alive):
                return low, high
            step += 1
            c = symbols[starts[alive] + sizes[alive] - step]
            zero, a, b = np.split(self.tree.descend(np.tile(c, 3), np.concatenate([np.zeros(len(c), np.int64), low[alive], high[alive]])), 3)
            low[alive], high[alive] = self.before[c] + a - zero, self.before[c] + b - zero

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes at ``rows``: steps back to the last sampled place."""
        place, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(open_):
            low = (row & 63).astype(np.uint64)
            word = self.marks[row >> 6]
            found = (word >> low) & np.uint64(1) == 1
            rank = self.marked[row >> 6] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))
            place[open_[found]] = self.samples[rank[found]].astype(np.int64) + steps[open_[found]]
            open_, row = open_[~found], row[~found]
            if len(open_):
                steps[open_] += 1
                symbol, below = self.tree.access(row)
                distinct, which = np.unique(symbol, return_inverse=True)
                row = self.before[symbol] + below - self.tree.descend(distinct, np.zeros(len(distinct), np.int64))[which]
        return place
