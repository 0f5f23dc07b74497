"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text, the encoding of that prefix ends in one certain token. The table stores that token for each
prefix: an Aho-Corasick automaton gives the pieces that end at a place, longest first, and the first piece that starts
the text, or whose pair with the last token before it is compatible, is the one (a pair is compatible if merging its
text again gives just the pair). The ids are then read backwards from the end. Work is linear in the text.

Pieces hold the space mark only at their front (or are runs of it), so a text is cut before each run of marks and equal
cuts are encoded once per worker. A character that is no piece falls back to its UTF-8 bytes and parts what is around it.
The model must be a BPE model with byte fallback, a dummy prefix and no other normalisation; others are refused.

Defined results: null and empty texts have no tokens and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches

MARK = "▁"
CUT = re.compile(f"{MARK}+[^{MARK}]*")
CACHE_ENTRIES = 500_000
CACHE_LENGTH = 48


class PrefixEncoder:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        odd = [p for p in self.id if MARK in p[1:] and p.strip(MARK)]
        if len(self.byte_id) != 256 or odd or sp.decode(sp.encode("  a  \uff21 ")) != "  a  \uff21 " or not self.pieces[sp.encode("a")[0]].startswith(MARK):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        self.special = {i for i in range(size) if sp.is_control(i)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by the rule itself: merge the best-scored adjacent pair, leftmost first, until none is a piece. Used on pairs of tokens only."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            x, y = self.pieces[a], self.pieces[b]
            known = self.fits[(a, b)] = self.merge(x + y) == [x, y]
        return known

    def encode_cuts(self, cuts: list[str]) -> list[list[int]]:
        """Ids of each cut, by one prefix table over all of them; a NUL, which is no piece, parts them."""
        text = "\0".join(cuts)
        n = len(text)
        last = [-1] * (n + 1)  # last token of each prefix; -1: none, the character before falls back to bytes
        width = [1] * (n + 1)
        known, compatible = self.fits.get, self.compatible
        for end, (size, token) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if before >= 0:
                    fit = known((before, token))
                    if fit is None:
                        fit = compatible(before, token)
                    if not fit:
                        continue
                last[end] = token
                width[end] = size
        found, at = [], -1
        for cut in cuts:
            start = at + 1
            at = start + len(cut)
            ids, end = [], at
            while end > start:
                token = last[end]
                if token >= 0:
                    ids.append(token)
                    end -= width[end]
                else:
                    end -= 1
                    ids += [self.byte_id[b] for b in reversed(text[end].encode("utf-8", "surrogatepass"))]
            ids.reverse()
            found.append(ids)
        return found

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, as the library decodes: the dummy prefix goes, bytes that are no UTF-8 become U+FFFD."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(self._utf8(held))
                held.clear()
            if i not in self.special:
                out.append(" ⁇ " if i == 0 else self.pieces[i].replace(MARK, " "))
        if held:
            out.append(self._utf8(held))
        text = "".join(out)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.pieces[first].startswith(MARK) else text

    @staticmethod
    def _utf8(data: bytearray) -> str:
        """Each byte that begins no valid sequence becomes one U+FFFD."""
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(bytes(data[at : at + size]).decode())
                except UnicodeDecodeError:
                    continue
                at += size
                break
            else:
                out.append("�")
                at += 1
        return "".join(out)

    @staticmethod
    def cuts(text: str) -> list[str]:
        """The text cut before each run of marks, each cut without its first mark."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CUT.findall(MARK + text.replace(" ", MARK))]

    def values(self, cuts: Iterable[list[str]]) -> dict[str, tuple[str, str]]:
        """What ``known`` makes of the ids of every distinct cut, from the cache or computed together."""
        now = set().union(*cuts)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache = self.cache = {c: cache[c] for c in now if c in cache}
        missing = [c for c in now if c not in cache]
        kept = cache
        if sum(map(len, missing)) > CACHE_LENGTH * len(missing) + 100_000:  # very long cuts are not kept
            kept = dict(cache)
        for k in range(0, len(missing), 5000):
            some = missing[k : k + 5000]
            for cut, ids in zip(some, self.encode_cuts([MARK + c for c in some]), strict=True):
                kept[cut] = self.keep(cut, ids)
        return kept

    def keep(self, cut: str, ids: list[int]):
        """What the cache holds of a cut: ids joined by commas, and the decoded text with its front mark as a space."""
        return ",".join(map(str, ids)), (" " if self.pieces[ids[0]].startswith(MARK) else "") + self.decode_ids(ids)

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_cuts([MARK + c for c in self.cuts(text)]) for i in ids]


_LOADED: dict[tuple, PrefixEncoder] = {}


def encoder(model_file: str, kind: type = PrefixEncoder) -> PrefixEncoder:
    """One encoder for each worker, model and kind."""
    if (model_file, kind) not in _LOADED:
        _LOADED[model_file, kind] = kind(model_file)
    return _LOADED[model_file, kind]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids (int array), decoded for each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        for batch in batches:
            ids, texts = [], []
            for text in batch.column(1):
                got = e.encode(text.as_py() or "")
                ids.append(got)
                texts.append(e.decode_ids(got))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts)], ["doc_id", "n_tokens", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    return _flat(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def _flat(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of what ``encode_documents`` gives, without keeping it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file)
        for batch in batches:
            counts, coded, decoded = [], [], []
            texts = [e.cuts(t or "") for t in batch.column(1).to_pylist()]
            known = e.values(texts)
            for cuts in texts:
                got = [known[c] for c in cuts]
                ids = ",".join([g[0] for g in got])
                counts.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                text = "".join([g[1] for g in got])
                decoded.append(hashlib.sha256(text[1:].encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return _flat(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
