"""Words as spellings: the bytes of chosen words one behind the other, and numbers of equal spellings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, text_buffer


def mapped(column: pa.Array, table: np.ndarray) -> pa.LargeStringArray:
    """A string column with each of its bytes replaced through ``table``; bytes of characters beyond ASCII must map to themselves."""
    data, offsets = text_buffer(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(table[data]))


class Spellings(Words):
    """Words of one slice with their spellings."""

    def spelled(self, which: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the words ``which`` one behind the other, each with a space after it where ``tails`` is 1."""
        starts, sizes = self.starts[which], self.ends[which] - self.starts[which]
        offsets = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes + tails, out=offsets[1:])
        at = np.arange(offsets[-1])
        at += np.repeat(starts - offsets[:-1], sizes + tails)
        out = np.append(self.data, np.uint8(32))[np.minimum(at, len(self.data))]
        out[offsets[1:][tails > 0] - 1] = 32
        return out, offsets

    def interned(self) -> tuple[np.ndarray, pa.Array]:
        """(number of each word's spelling, spellings); spellings are numbered in the order in which they come up."""
        if not len(self.starts):
            return np.zeros(0, np.int64), pa.array([], pa.large_binary())
        out, offsets = self.spelled(np.arange(len(self.starts)), np.zeros(len(self.starts), np.int64))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary
