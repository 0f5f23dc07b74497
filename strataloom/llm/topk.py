"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers, floor(256 * x). Each block of vectors is indexed by dimension and side: for a query whose component
is positive the impact of a vector is its component above the block's least one, for a negative one its distance below the
greatest, so that impacts add to the score and are never negative. The postings of a dimension and side are cut into
segments of descending impact. A query takes segments by descending impact times weight and adds to its accumulators; what
a vector can still gain is bounded by the heads of the segments that are left. It stops when no vector outside the
possible members can reach the k-th best sum, which is a proof; the possible members are then scored exactly.

Groups of queries are copied to each block of vectors by an equi-join on the block, so blocks, the larger side, stay as they are,
all work is spread and no side is broadcast.

Defined results: null vectors and vectors with null or non-finite components take no part; missing components of shorter
vectors count as 0; a query never finds rows with its own vec_id; rows that repeat a vec_id are candidates each, and a
query id that repeats is answered once for each of its distinct vectors (told apart by a 64-bit hash; equal repeats once); ties go
to the smaller vec_id; an empty table gives no rows; other columns, whatever their names, are ignored. Sums must fit 64 bits (|x|
below 2**20 does).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

K = 5
SCALE = 256
QUERY_STEP = 50
BLOCK_ROWS = 8192
GROUP_ROWS = 1024
SEGMENTS = 8


class ImpactIndex:
    """Index of one block: ids and an integer matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, segments: int = SEGMENTS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, self.dims = self.vectors.shape
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(np.int64))
        down = np.argsort(-self.vectors, axis=0, kind="stable")
        self.rows = (np.ascontiguousarray(down.T), np.ascontiguousarray(down[::-1].T))
        above = np.ascontiguousarray((self.vectors - self.low).T)
        below = np.ascontiguousarray((self.high - self.vectors).T)
        self.impacts = (np.take_along_axis(above, self.rows[0], 1), np.take_along_axis(below, self.rows[1], 1))

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of this block without ``own``, by score, then smaller id."""
        n = len(self.ids)
        weight, side = np.abs(query), (query < 0).astype(np.int64)
        used = np.flatnonzero(weight)
        floor = int((query * np.where(side == 1, self.high, self.low)).sum())
        sums = np.zeros(n, np.int64)
        mine = self.ids == own
        starts = self.cuts[:-1]
        heads = np.array([self.impacts[side[d]][d, starts] * weight[d] for d in used]) if len(used) else np.zeros((0, len(starts)), np.int64)
        order = np.argsort(-heads, axis=None, kind="stable")
        left = np.append(heads, np.zeros((len(used), 1), np.int64), axis=1) if len(used) else heads
        at = np.zeros(len(used), np.int64)
        bound = int(left[:, 0].sum()) if len(used) else 0  # what a vector in no list so far can still gain
        possible = np.flatnonzero(~mine)
        if len(possible) > k:
            for step, flat in enumerate(order):
                j, s = divmod(int(flat), len(starts))
                d = used[j]
                a, b = self.cuts[s], self.cuts[s + 1]
                rows = self.rows[side[d]][d, a:b]
                sums[rows] += self.impacts[side[d]][d, a:b] * weight[d]
                bound += int(left[j, s + 1] - left[j, s])
                at[j] = s + 1
                if step % 32 == 31 and step + 1 < len(order):
                    got = np.where(mine, -1, sums)
                    kth = int(np.partition(got, n - k)[n - k])
                    possible = np.flatnonzero((got + bound >= kth) & ~mine)
                    if len(possible) <= 4 * k:
                        break
            else:
                got = np.where(mine, -1, sums)
                possible = np.flatnonzero((got >= np.partition(got, n - k)[n - k]) & ~mine)
        exact = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -exact))[:k]
        assert not len(best) or exact[best[0]] >= floor
        return [(int(exact[i]), int(self.ids[possible[i]])) for i in best]


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    e = F.col("embedding")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ok = e.isNotNull() & F.forall(e, lambda x: finite(x.cast("double")))
    return vectors.filter(F.col("vec_id").isNotNull() & ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def _packed(flat: DataFrame, limit: int) -> DataFrame:
    """Rows of each partition in blocks of at most ``limit``: (part, ids, dims, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list]] = []

        def block() -> pa.RecordBatch:
            dims = max(len(x[2]) for x in held)
            v = np.zeros((len(held), dims), np.int64)
            for row, (_, _, x) in zip(v, held, strict=True):
                row[: len(x)] = x
            ids = np.array([x[1] for x in held], np.int64)
            part = held[0][0]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "ids", "dims", "v"])

        for batch in batches:
            for part, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != part or len(held) >= limit):
                    yield block()
                held.append((part, i, v))
        if held:
            yield block()

    return flat.select("part", "vec_id", "v").mapInArrow(run, "part int, ids binary, dims int, v binary")


def _matrix(ids: bytes, dims: int, v: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(v, np.int64).reshape(-1, dims) if dims else np.zeros((len(ids) // 8, 0), np.int64)
    if dims < width:
        m = np.pad(m, ((0, 0), (0, width - dims)))
    return np.frombuffer(ids, np.int64), m


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``step``, its ``k`` best others."""
    flat = materialize(integer_vectors(vectors), "vectors")
    n, m = flat.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % step == 0)).first()
    n_blocks, n_groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // GROUP_ROWS))

    def dealt(df: DataFrame, parts: int, limit: int) -> DataFrame:
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
        return _packed(df.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", "vec_id"), limit)

    blocks = dealt(flat, n_blocks, BLOCK_ROWS).drop("part").withColumn("b", F.monotonically_increasing_id())
    blocks = materialize(blocks, "blocks")
    numbers = [r.b for r in blocks.select("b").collect()]  # one for each ``BLOCK_ROWS`` vectors
    groups = dealt(flat.filter(F.col("vec_id") % step == 0).distinct(), n_groups, GROUP_ROWS)
    groups = materialize(groups.select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("v").alias("q_v")), "queries")
    spread = groups.withColumn("b", F.explode(F.array(*[F.lit(b).cast("long") for b in numbers])) if numbers else F.lit(0).cast("long"))
    # A task for each block or two: the blocks are few and heavy, so the engine must not merge their partitions.
    met = blocks.repartition(2 * n_blocks, "b").hint("merge").join(spread.repartition(2 * n_blocks, "b"), "b").select("ids", "dims", "v", "q_ids", "q_dims", "q_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for ids, dims, v, q_ids, q_dims, q_v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = max(dims, q_dims)
                key = (ids, width)
                if key != last:
                    last, index = key, ImpactIndex(*_matrix(ids, dims, v, width))
                out: list[list] = [[], [], [], []]
                for q, x in zip(*_matrix(q_ids, q_dims, q_v, width), strict=True):
                    which = int.from_bytes(hashlib.blake2b(np.trim_zeros(x, "b").tobytes(), digest_size=8).digest(), "little", signed=True)
                    for score, i in index.top(x, int(q), k):
                        for o, value in zip(out, (int(q), i, score, which), strict=True):
                            o.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["query_id", "vec_id", "score", "which"])

    best = met.mapInArrow(run, "query_id long, vec_id long, score long, which long")
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
