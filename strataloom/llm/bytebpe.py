"""Byte-level BPE ids of whole texts, as unsigned 16-bit integers."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable

import numpy as np

# Fixed value: the pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = "<|endoftext|>"
END_ID = 50256


class ByteEncoder:
    """Encoder of a vocabulary file of base64 tokens and ranks, or of a tokenizer.json with the same contents."""

    def __init__(self, ranks_file: str):
        from tiktoken import _tiktoken

        with open(ranks_file, "rb") as f:
            if f.read(1) == b"{":
                ranks = self._from_json(ranks_file)
            else:
                f.seek(0)
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = _tiktoken.CoreBPE(ranks, {}, PATTERN).encode_ordinary
        self.lengths = {i: len(token) for token, i in ranks.items()}

    @staticmethod
    def _from_json(path: str) -> dict[bytes, int]:
        import json

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token != END}

    def token_bytes(self, size: int) -> np.ndarray:
        """Length in bytes of each token; 1 for ids that are none."""
        return np.array([self.lengths.get(i, 1) for i in range(size)], np.float64)

    def ids(self, text: str) -> list[int]:
        """Ids of a text; the end mark's string is its one id, as the library takes it by default."""
        if END not in text:
            return self.ordinary(text)
        first, *rest = text.split(END)
        out = self.ordinary(first)
        for part in rest:
            out.append(END_ID)
            out += self.ordinary(part)
        return out

    def encode_all(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        return [array("H", self.ids(t)).tobytes() for t in texts]


_LOADED: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """One encoder for each worker and file; it holds the vocabulary and nothing of the texts."""
    if path not in _LOADED:
        _LOADED[path] = ByteEncoder(path)
    return _LOADED[path]
