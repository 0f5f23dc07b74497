"""Lexical retrieval packing: sequences filled with documents that BM25 finds near their seed.

Documents become token ids once, and each gets a content signature: the least token under a few fixed random orders in which
longer tokens tend to come first (weighted min-wise sampling), so documents that share much share their signature with about
the probability of their weighted overlap. The corpus is sorted by signature and cut into shards of bounded size; a group of
copies of any size spreads over as many neighbouring shards as it needs. The order depends on contents alone, not on the place
where a document is stored; where one shard ends and the next begins follows from the ranges of the sort, which are drawn from
the partitions of the input, so the same rows in other partitions may be packed otherwise.

Terms are token ids, so document frequencies over the whole corpus are a table of the vocabulary's size. Each shard has an
inverted index. The first unused document seeds a window; all its terms query the index, and the unused documents of the
highest scores follow it until the window is full. The last one is cut where the window ends and its rest seeds the next
window. What is left at a shard's end is cut into powers of two, which need no padding.

A seed is not compared with other shards, so neighbours in other shards are missed: a search of every shard for every seed
would read the whole index once a shard, beyond the CPU that this operator may take. ``shard_recall`` measures what is missed.

Defined results: null and empty texts are one end id; repeated rows are packed each; every id lies in exactly one piece; ties
go to the row that sorts first by signature, then by a hash of doc_id; texts of any length are encoded whole and span as many
sequences as they need; an empty table gives no pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_encoder
from .store import bounded_batches, give_back, materialize
from .words import mix, slices

WINDOW = 1024
SHARD_ROWS = 4000
SHARD_IDS = 6_000_000
SIGNATURE = 4  # tokens of a content signature
K1, B = 1.2, 0.75
VOCABULARY = 50_257

PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def signature_orders(token_bytes: np.ndarray, n: int = SIGNATURE) -> list[np.ndarray]:
    """Places of all tokens in ``n`` random orders; a token is first among others with a chance by the square of its length in bytes."""
    out = []
    for k in range(n):
        u = ((mix(np.arange(len(token_bytes), dtype=np.uint64) + np.uint64(1_000_003 * (k + 1))) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        place = np.empty(len(token_bytes), np.uint16)
        place[np.argsort(-np.log(u) / token_bytes**2.0, kind="stable")] = np.arange(len(token_bytes), dtype=np.uint16)
        out.append(place)
    return out


def signatures(ids: list[bytes], orders: list[np.ndarray]) -> list[np.ndarray]:
    """For each order, the least place of any token of each document; 65535 for a document without tokens."""
    size = np.array([len(x) // 2 for x in ids], np.int64)
    some = np.flatnonzero(size)
    flat = np.frombuffer(b"".join(ids), np.uint16)
    first = np.concatenate(([0], np.cumsum(size)))[:-1][some]
    out = []
    for place in orders:
        least = np.full(len(ids), 65535, np.int32)
        if len(some):
            least[some] = np.minimum.reduceat(place[flat], first)
        out.append(least)
    return out


KEYS = [f"k{k}" for k in range(SIGNATURE)]


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows (doc_id, ids, signature) with ids as unsigned 16-bit integers and the end id 0 last, and a row of each task's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = byte_encoder(tokenizer)
        orders = signature_orders(e.token_bytes(VOCABULARY))
        df, rows, total = np.zeros(VOCABULARY, np.int64), 0, 0
        seen = np.zeros(VOCABULARY, np.uint8)
        names = ["doc_id", "ids", *KEYS, "n_rows", "n_ids", "df"]
        no_keys = [pa.nulls(1, pa.int32())] * SIGNATURE
        for batch in batches:
            for part in slices(batch, "text"):
                got = e.encode_all([t or "" for t in part.column(1).to_pylist()])
                some = np.zeros(VOCABULARY, np.uint32)
                for ids in got:
                    terms = np.frombuffer(ids, np.uint16)
                    seen[terms] = 1
                    some += seen
                    seen[terms] = 0
                    total += len(terms)
                df += some
                rows += len(got)
                n = len(got)
                keys = [pa.array(k) for k in signatures(got, orders)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + b"\0\0" for x in got], pa.binary()), *keys, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        give_back()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *no_keys, pa.array([rows], pa.int64()), pa.array([total], pa.int64()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], names)

    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return flat.mapInArrow(run, "doc_id long, ids binary, " + "".join(f"{k} int, " for k in KEYS) + "n_rows long, n_ids long, df binary")


def corpus_statistics(counts: DataFrame) -> tuple[int, int, np.ndarray]:
    """(rows, ids, df): tables of the vocabulary's fixed size are summed on the executors, a bounded number reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, ids = np.zeros(VOCABULARY, np.int64), 0, 0
        for batch in batches:
            for r, n, d in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, ids, df = rows + r, ids + n, df + np.frombuffer(zlib.decompress(d), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([ids], pa.int64()), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], ["n_rows", "n_ids", "df"])

    schema = "n_rows long, n_ids long, df binary"
    parts = counts.select("n_rows", "n_ids", "df").repartition(8).mapInArrow(add, schema).collect()
    df = np.zeros(VOCABULARY, np.int64)
    for r in parts:
        df += np.frombuffer(zlib.decompress(bytes(r.df)), np.int64)
    return sum(r.n_rows for r in parts), sum(r.n_ids for r in parts), df


class Shard:
    """Inverted BM25 index over the rows of one shard, with unused rows to hand out."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(ids)
        self.unused = np.ones(n, bool)
        lengths = np.array([len(x) for x in ids], np.int64)
        # Row and term of each id in 32 bits: a shard has fewer than 65536 rows.
        keys = np.sort(np.repeat(np.arange(n, dtype=np.uint32) << np.uint32(16), lengths) | np.concatenate(ids)) if n else np.zeros(0, np.uint32)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.append(at, len(keys))).astype(np.float64)
        row, term = (keys[at] >> 16).astype(np.int64), (keys[at] & 65535).astype(np.int64)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / max(mean, 1e-9)))).astype(np.float32)
        self.row_at = np.searchsorted(row, np.arange(n + 1))
        self.row_term = term
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weight[order]
        self.term_at = np.searchsorted(term[order], np.arange(65537))
        # The lists of terms that an eighth of the rows have are held with a place for each row: adding one is a plain sum.
        often = np.flatnonzero(np.diff(self.term_at) * 8 > n)
        self.full = dict(zip(often.tolist(), np.zeros((len(often), n), np.float32), strict=True))
        for t, values in self.full.items():
            values[self.rows[self.term_at[t] : self.term_at[t + 1]]] = self.weights[self.term_at[t] : self.term_at[t + 1]]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all rows for all terms of ``seed``."""
        a, b = self.row_at[seed], self.row_at[seed + 1]
        score = np.zeros(len(self.unused), np.float32)
        for t in self.row_term[a:b].tolist():
            values = self.full.get(t)
            if values is not None:
                score += values
            else:
                x, y = self.term_at[t], self.term_at[t + 1]
                score[self.rows[x:y]] += self.weights[x:y]
        return score

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused rows by descending score, ties to the earlier row; then the rest in order."""
        score = self.scores(seed)
        score[~self.unused] = -1
        while True:
            best = int(np.argmax(score))
            if score[best] < 0:
                return
            score[best] = -1
            yield best


def fill(doc_tokens: list[int], shard: Shard, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of a shard as lists of (row, start, length)."""
    n, cursor = len(doc_tokens), 0
    rest: tuple[int, int] | None = None  # a row that was cut, and its ids before the cut
    while True:
        if rest is None:
            while cursor < n and not shard.unused[cursor]:
                cursor += 1
            if cursor == n:
                return
            shard.unused[cursor] = False
            rest = (cursor, 0)
        row, start = rest
        rest, room, seq = None, window, []
        near = None
        while True:
            take = min(room, doc_tokens[row] - start)
            seq.append((row, start, take))
            room -= take
            if start + take < doc_tokens[row]:
                rest = (row, start + take)
            if not room:
                break
            if near is None:
                near = shard.neighbours(row)
            row, start = next(near, -1), 0
            if row < 0:
                break
            shard.unused[row] = False
        yield seq


def powers_of_two(seq: list[tuple[int, int, int]], window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Cut a sequence that isn't full into sequences whose lengths are powers of two."""
    total = sum(x[2] for x in seq)
    if total == window:
        yield seq
        return
    queue = list(reversed(seq))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            row, start, length = queue.pop()
            take = min(room, length)
            out.append((row, start, take))
            if take < length:
                queue.append((row, start + take, length - take))
            room -= take
        yield out


def by_content(tokens: DataFrame) -> DataFrame:
    """Rows (doc_id, ids) sorted by signature over all partitions. A hash of doc_id ends the key, so equal signatures split."""
    order = [*KEYS, F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids")]
    return tokens.filter("ids is not null").select("doc_id", "ids", *KEYS).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 16-bit)."""
    bounded_batches(docs.sparkSession)
    both = materialize(tokenize(docs, tokenizer), "ids")
    n_rows, n_ids, df = corpus_statistics(both.filter("df is not null"))
    idf = np.log1p((n_rows - df + 0.5) / (df + 0.5))
    mean = n_ids / max(n_rows, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 36, 0
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = [np.frombuffer(x[1], np.uint16) for x in held]
            tokens = [len(x) for x in ids]
            shard = Shard([x[:-1] for x in ids], idf, mean)
            cols: list[list] = [[] for _ in range(8)]
            for whole in fill(tokens, shard, window):
                for seq in powers_of_two(whole, window):
                    offset = 0
                    for row, start, length in seq:
                        part = ids[row][start : start + length]
                        for c, v in zip(cols, (held[row][0], start, length, zlib.crc32(part.astype("<u4").tobytes()), tokens[row], base + made, offset, part.tobytes()), strict=True):
                            c.append(v)
                        offset += length
                    made += 1
            held.clear()
            for k in range(0, len(cols[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 5000], pa.binary() if j == 7 else pa.int64()) for j, c in enumerate(cols)], [x.split()[0] for x in PIECES_DDL.split(", ")])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((i, x))
                size += len(x) // 2
                if len(held) >= SHARD_ROWS or size >= SHARD_IDS:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        give_back()

    return by_content(both).mapInArrow(run, PIECES_DDL)


def shard_recall(ids: list[np.ndarray], shard: np.ndarray, seeds: list[int], k: int = 10) -> tuple[float, float]:
    """For documents held in memory: the share of each seed's ``k`` best documents of the corpus that its shard holds, and the
    best score in the shard as a share of the best score in the corpus."""
    df = np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=VOCABULARY)
    whole = Shard(ids, np.log1p((len(ids) - df + 0.5) / (df + 0.5)), float(np.mean([len(x) for x in ids])))
    found, share = [], []
    for s in seeds:
        score = whole.scores(s)
        score[s] = -1
        best = np.argsort(-score, kind="stable")[:k]
        found.append(np.mean(shard[best] == shard[s]))
        inside = score[shard == shard[s]].max()
        share.append(max(inside, 0) / score[best[0]] if score[best[0]] > 0 else 1.0)
    return float(np.mean(found)), float(np.mean(share))
