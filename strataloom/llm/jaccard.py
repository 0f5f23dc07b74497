"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The incidence matrix holds a column block for each bucket of n-gram hashes and a row block for each bucket of set
identifiers; blocks travel as packed arrays, never as a row per n-gram.

1. Rows of the matrix: the distinct word shingles of a document. Documents with the same set are one row.
2. Column blocks: n-grams that occur in one set only can't add to any overlap and are dropped; others go back to their
   rows together with the number of sets that hold them.
3. Size-derived bounds. Two sets of sizes m and n can only reach the similarity t if their overlap is at least
   t * max(m, n). So a set less than t of whose n-grams occur elsewhere is dropped, and only the ``c - ceil(t * n) + 1``
   rarest of its ``c`` shared n-grams (its prefix) have to meet a partner's prefix: the pair is a candidate if one does.
4. The overlap of candidates is accumulated from their full shared columns and the exact bound decides.

Only the components are wanted, so pairs are never expanded inside a group. A first round compares each set with the
set that it meets most often as the least of a column. Further rounds compare a few drawn pairs for each component that
still meets another, for as long as that finds links. A last round takes every pair of sets that meet and lie in
different components and that sizes, places in the prefixes and parity sketches of the sets leave room for. Pairs inside
a component need no comparison, so no link between different texts is lost.

Blocks of columns and rows are as many as keep a block at about ``BLOCK_ENTRIES`` entries, so what a task holds does not grow with
the corpus (up to ``MOST_BLOCKS`` blocks) but for n-grams that very many different sets share. N-grams are told apart by 48 bits and the bucket's number, sets
by 64 bits: among S distinct n-grams about S * S / 2**(49 + log2(buckets)) pairs are taken for one, which can shift an overlap by
one each. That is under one pair up to some 10 ** 8 n-grams in 64 buckets and some thousands of pairs at 10 ** 10.

Defined results: null text, empty text and text without words have an empty set and link with nothing; repeated rows
share their class; a null doc_id is returned as it is and never names a component unless the class has no other id; texts of any
length are read whole, a batch of them at a time; an empty table gives no rows; other columns, whatever their names, are ignored
(``similarity_classes``) or kept (``keep_one``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .store import bounded_batches, buckets, drop, give_back, materialize
from .words import mix, shingle_sets, slices

WIDTH = 5
NUM, DEN = 75, 100  # similarity of 0.75 as an exact fraction
BLOCK_ENTRIES, LIST_ENTRIES, LEAST_ENTRIES, MOST_BLOCKS = 800_000, 1_000_000, 100_000, 1 << 20

BLOCK = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("sids", pa.binary()), ("cnts", pa.binary()), ("hs", pa.binary()), ("dfs", pa.binary())])
BLOCK_DDL = "bucket int, part int, sids binary, cnts binary, hs binary, dfs binary"


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap that a set of size ``n`` can have with any partner."""
    return -(-NUM * n // DEN)


def set_id(s: np.ndarray) -> int:
    """Identifier of a set: one 64-bit hash of its members, signed. The empty set has 0."""
    if not len(s):
        return 0
    x = mix(np.array([np.add.reduce(mix(s + np.uint64(0x51ED27))), np.bitwise_xor.reduce(s * np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(len(s))], np.uint64))
    return int(mix(x[:1] * np.uint64(3) + x[1:2] * np.uint64(5) + x[2:] * np.uint64(7)).view(np.int64)[0]) or 1


def _pack48(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _pack(x: np.ndarray) -> bytes:
    """Small numbers in as few bytes each as the largest takes; ``_unpack`` knows from how many there are."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _unpack(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(b) // n] if n else np.uint8).astype(np.int64)


def _blocks(bucket: np.ndarray, n_buckets: int, part: int, row: np.ndarray, sids: np.ndarray, h48: np.ndarray, dfs: np.ndarray | None) -> pa.RecordBatch:
    """One packed block for each bucket; ``row`` points into ``sids`` and ascends within a bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, row, h48 = bucket[order], row[order], h48[order]
    dfs = None if dfs is None else dfs[order]
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
    cols: list[list] = [[] for _ in BLOCK]
    for k in np.flatnonzero(np.diff(cut)):
        a, b = cut[k], cut[k + 1]
        r = row[a:b]
        at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        values = (int(k), part, sids[r[at]].tobytes(), _pack(np.diff(np.append(at, len(r)))), _pack48(h48[a:b]), b"" if dfs is None else _pack(dfs[a:b]))
        for c, v in zip(cols, values, strict=True):
            c.append(v)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOCK, strict=True)], schema=BLOCK)


def _gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sid, h48, df, part) of each entry of the blocks of a group."""
    sid, h, df, part = [], [], [], []
    for s, c, x, d, p in zip(*(table.column(k).to_pylist() for k in ("sids", "cnts", "hs", "dfs", "part")), strict=True):
        h.append(_unpack48(x))
        n = len(h[-1])
        sid.append(np.repeat(np.frombuffer(s, np.int64), _unpack(c, len(s) // 8)))
        df.append(_unpack(d, n) if d else np.zeros(n, np.int64))
        part.append(np.full(n, p, np.uint64))
    return tuple(np.concatenate(x) for x in (sid, h, df, part))


def incidence(docs: DataFrame, n_buckets: int, width: int = WIDTH) -> DataFrame:
    """Blocks of the incidence matrix; a set that repeats within a task is sent once for each of its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal total
            if held:
                sids = np.fromiter(held, np.int64, len(held))
                h = np.concatenate(list(held.values()))
                row = np.repeat(np.arange(len(sids)), [len(s) for s in held.values()])
                yield _blocks((h % np.uint64(n_buckets)).astype(np.int64), n_buckets, 0, row, sids, h >> np.uint64(16), None)
                held.clear()
                total = 0

        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), width)
                ids = [set_id(s) for s in sets]
                for i, s in zip(ids, sets, strict=True):
                    if len(s) and i not in held:
                        held[i] = s
                        total += len(s)
                if total > 1_500_000:
                    yield from flush()
        yield from flush()
        give_back()

    return _flat(docs).select("doc_id", "text").mapInArrow(run, BLOCK_DDL)


def _flat(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, th, sid, n: a hash of each document's text, which set it has, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "th", "sid", "n"])

    return _flat(docs).mapInArrow(run, "doc_id long, th long, sid long, n long")


def _columns(n_buckets: int):
    """Column block: keep n-grams of two sets or more, send them to the row blocks with their number of sets."""

    def run(key, table):
        (hb,) = (k.as_py() for k in key)
        give_back()
        sid, h, _, _ = _gather(table)
        order = np.argsort(h, kind="stable")
        sid, h = sid[order], h[order]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1
        sid, h = sid[keep], h[keep]
        order = np.lexsort((sid, h))
        sid, h = sid[order], h[order]
        if len(h):  # an entry that several batches sent counts once
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])))
            sid, h = sid[once], h[once]
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            df = count[inverse]
            keep = df > 1
            sid, h, df = sid[keep], h[keep], df[keep]
        if not len(h):
            return BLOCK.empty_table()
        order = np.argsort(sid, kind="stable")
        sid, h, df = sid[order], h[order], df[order]
        first = np.concatenate(([True], sid[1:] != sid[:-1]))
        row = np.cumsum(first) - 1
        batch = _blocks((sid.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64), n_buckets, hb, row, sid[first], h, df)
        return pa.Table.from_batches([batch])

    return run


SIZES_DDL = "bucket int, sids binary, ns binary"


def _sizes(info: DataFrame, n_buckets: int) -> DataFrame:
    """Sets and their sizes by row block; sent once for each batch, so the matrix's entries need not carry them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, at = np.unique(np.asarray(batch.column(0)).astype(np.int64), return_index=True)
            ns = np.asarray(batch.column(1)).astype(np.int64)[at]
            bucket = (sids.view(np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            some = np.flatnonzero(np.diff(cut))
            pick = [order[cut[k] : cut[k + 1]] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sids[i].tobytes() for i in pick], pa.binary()), pa.array([ns[i].tobytes() for i in pick], pa.binary())], ["bucket", "sids", "ns"])

    return info.filter("n > 0").select("sid", "n").mapInArrow(run, SIZES_DDL)


ROWS = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("members", pa.binary()), ("prefix", pa.binary()), ("sketch", pa.binary())])
ROWS_DDL = "sid long, n long, members binary, prefix binary, sketch binary"
SKETCH_BITS = 512


def parity_sketch(members: np.ndarray) -> bytes:
    """A bit for each residue of the members' hashes: whether an odd number of members has it.

    Two sets' sketches differ in at most as many bits as the sets differ in members, so the sketches bound the overlap.
    """
    odd = np.bincount((mix(members) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _rows(key, table, sizes):
    """Row block: drop sets that can't reach the bound, give the rest their shared members and their prefix."""
    give_back()
    if not table.num_rows:
        return ROWS.empty_table()
    sid, h, df, part = _gather(table)
    member = mix(h ^ mix(part))
    order = np.lexsort((member, df, sid))
    sid, df, member = sid[order], df[order], member[order]
    at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
    known, first = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in sizes.column("sids").to_pylist()]), return_index=True)
    size_of = np.concatenate([np.frombuffer(x, np.int64) for x in sizes.column("ns").to_pylist()])[first]
    sizes_here = size_of[np.searchsorted(known, sid[at])]
    cols: list[list] = [[] for _ in ROWS]
    for a, b, size in zip(at, np.append(at[1:], len(sid)), sizes_here.tolist(), strict=True):
        least = int(need(size))
        if b - a >= least:
            for c, v in zip(cols, (int(sid[a]), size, np.sort(member[a:b]).tobytes(), member[a : a + (b - a) - least + 1].tobytes(), parity_sketch(member[a:b])), strict=True):
                c.append(v)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROWS, strict=True)], schema=ROWS)


LISTS_DDL = "bucket int, sids binary, ns binary, cs binary, labels binary, sketches binary, cnts binary, hs binary, ps binary"


def _lists(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Posting entries of the prefixes in packed blocks by n-gram: set, size, shared members, label, place in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sids, ns, labels, cs = (np.asarray(batch.column(k)).astype(np.int64) for k in (0, 1, 3, 4))
            got = [np.frombuffer(p, np.uint64) for p in batch.column(2).to_pylist()]
            row, h = np.repeat(np.arange(len(got)), [len(g) for g in got]), np.concatenate(got)
            sketches = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8)
            place = np.concatenate([np.arange(len(g), dtype=np.uint32) for g in got])
            bucket = (mix(h) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, row, h, place = bucket[order], row[order], h[order], place[order]
            cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
            out: list[list] = [[] for _ in range(9)]
            for k in np.flatnonzero(np.diff(cut)):
                r = row[cut[k] : cut[k + 1]]
                at = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                u = r[at]
                values = (int(k), sids[u].tobytes(), ns[u].tobytes(), cs[u].tobytes(), labels[u].tobytes(), sketches[u].tobytes(), np.diff(np.append(at, len(r))).astype(np.uint32).tobytes(), h[cut[k] : cut[k + 1]].tobytes(), place[cut[k] : cut[k + 1]].tobytes())
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            types = (pa.int32(), *[pa.binary()] * 8)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in LISTS_DDL.split(", ")])

    return rows.select("sid", "n", "prefix", "label", (F.octet_length("members") / 8).cast("long").alias("c"), "sketch").mapInArrow(run, LISTS_DDL)


class Postings:
    """Entries of a bucket sorted by n-gram, then label, then sid: arrays h, label, sid, n, c, place, and sketches by ``at``."""

    def __init__(self, table: pa.Table):
        kinds = {"sids": np.int64, "ns": np.int64, "cs": np.int64, "labels": np.int64}
        runs = np.concatenate([np.frombuffer(c, np.uint32) for c in table.column("cnts").to_pylist()])
        at = np.repeat(np.arange(len(runs)), runs)
        whole = {k: np.frombuffer(b"".join(table.column(k).to_pylist()), kind) for k, kind in kinds.items()}
        h = np.frombuffer(b"".join(table.column("hs").to_pylist()), np.uint64)
        place = np.frombuffer(b"".join(table.column("ps").to_pylist()), np.uint32)
        self.sketches = np.frombuffer(b"".join(table.column("sketches").to_pylist()), np.uint64).reshape(len(runs), -1)
        order = np.lexsort((whole["sids"][at], whole["labels"][at], h))
        self.at = at[order]
        self.sid, self.n, self.c, self.label = (whole[k][self.at] for k in kinds)
        self.h, self.place = h[order], place[order].astype(np.int64)
        self.new = np.concatenate(([True], self.h[1:] != self.h[:-1]))

    def may_link(self, i, j, first: bool) -> np.ndarray:
        """Whether entries i and j of one n-gram may be of linked sets, by sizes, places and sketches.

        Before this n-gram the sets share at most min(places) members, none if it is the first that they share; from it on
        at most the shorter rest. A link leaves at most a seventh of both sizes outside the overlap.
        """
        n, m, c, d, p, q = self.n[i], self.n[j], self.c[i], self.c[j], self.place[i], self.place[j]
        ahead = np.minimum(c - p, d - q) + (0 if first else np.minimum(p, q))
        ok = (DEN + NUM) * ahead >= NUM * (n + m)
        apart = np.bitwise_count(self.sketches[self.at[i]] ^ self.sketches[self.at[j]]).sum(axis=-1, dtype=np.int64) + (n - c) + (m - d)
        return ok & ((DEN + NUM) * apart <= (DEN - NUM) * (n + m))


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("la", pa.int64()), ("lb", pa.int64()), ("met", pa.int64())])
PAIRS_DDL = ", ".join(f"{f.name} long" for f in PAIRS)


def _pairs(a, b, la, lb) -> pa.Table:
    """Distinct (a, b) with the number of n-grams in which they met."""
    if not len(a):
        return PAIRS.empty_table()
    order = np.lexsort((b, a))
    a, b, la, lb = a[order], b[order], la[order], lb[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return pa.Table.from_arrays([pa.array(x[at]) for x in (a, b, la, lb)] + [pa.array(np.diff(np.append(at, len(a))))], schema=PAIRS)


def _heads(turn: int):
    """In each column, a set of each component meets one of the first component: linear in the column.

    In the first turn these are the least sets, later ones are drawn by hashes.
    """

    def run(key, table):
        e = Postings(table)
        group_at = np.flatnonzero(e.new | np.concatenate(([True], e.label[1:] != e.label[:-1])))
        size = np.diff(np.append(group_at, len(e.h)))
        first = e.new[group_at]
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]  # the first component of each group's column
        x, y = lead[~first], np.flatnonzero(~first)
        i, j = group_at[x], group_at[y]
        if turn:
            r = mix(e.h[j] + e.label[j].view(np.uint64) * np.uint64(2 * turn + 1))
            i = i + (r % size[x].astype(np.uint64)).astype(np.int64)
            j = j + ((r >> np.uint64(32)) % size[y].astype(np.uint64)).astype(np.int64)
        keep = e.may_link(i, j, first=False)
        i, j = i[keep], j[keep]
        return _pairs(e.sid[i], e.sid[j], e.label[i], e.label[j])

    return run


def _across(key, table):
    """All pairs of a column whose labels differ and that may link if they meet here first; a linked pair passes where it does."""
    e = Postings(table)
    list_at = np.flatnonzero(e.new)
    out: list[list] = [[], []]
    for a, b in zip(list_at, np.append(list_at[1:], len(e.h)), strict=True):
        if e.label[a] == e.label[b - 1]:
            continue
        ends = np.searchsorted(e.label[a:b], e.label[a:b], side="right") + a
        for i in range(a, b):
            if ends[i - a] < b:
                j = np.arange(ends[i - a], b)
                j = j[e.may_link(i, j, first=True)]
                if len(j):
                    out[0].append(np.full(len(j), i))
                    out[1].append(j)
    if not out[0]:
        return PAIRS.empty_table()
    i, j = (np.concatenate(o) for o in out)
    return _pairs(e.sid[i], e.sid[j], e.label[i], e.label[j])


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs whose accumulated overlap reaches the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for ma, mb, na, nb in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(ma.as_buffer(), np.uint64), np.frombuffer(mb.as_buffer(), np.uint64)
                if len(x) < len(y):
                    x, y = y, x
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                overlap = int(np.count_nonzero(x[at] == y))
                keep.append(DEN * overlap >= NUM * (na + nb - overlap))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = rows.select(F.col("sid").alias("a"), F.col("members").alias("ma"), F.col("n").alias("na"))
    right = rows.select(F.col("sid").alias("b"), F.col("members").alias("mb"), F.col("n").alias("nb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ma", "mb", "na", "nb").mapInArrow(run, "a long, b long")


def link_classes(rows: DataFrame, n_buckets: int, rounds: int = 4) -> DataFrame:
    """(node, root) over sets that link with another; rows(sid, n, members, prefix, sketch)."""
    labels, edges = None, None
    stored: list[DataFrame] = []  # tables of links, of no use once the last labels are stored

    def lists() -> DataFrame:
        if labels is None:
            return _lists(rows.withColumn("label", F.col("sid")), n_buckets).groupBy("bucket")
        return _lists(rows.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("root", "sid")), n_buckets).groupBy("bucket")

    turn, drawing = 0, True
    while True:
        if drawing:
            met = lists().applyInArrow(_heads(turn), PAIRS_DDL).groupBy("la", "lb", "a", "b").agg(F.sum("met").alias("met"))
            pair = F.struct("a", "b")
            picks = [F.max_by(pair, F.struct("met", F.xxhash64("a", "b")))] + ([F.max_by(pair, F.xxhash64("a", "b", F.lit(k))) for k in range(2)] if turn else [])
            pairs = met.groupBy("lb").agg(F.array_distinct(F.array(*picks)).alias("p")).select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()
        else:
            met = lists().applyInArrow(_across, PAIRS_DDL)
            pairs = met.select("a", "b").distinct()
        pairs = materialize(pairs, "pairs")
        if not pairs.limit(1).count():
            drop(pairs)
            if not drawing:
                drop(*stored)
                return labels
            drawing = False  # a draw looks at few pairs of a column, so an empty one proves nothing
            continue
        found = materialize(_linked(pairs, rows), "links")
        drop(pairs)
        stored.append(found)
        grew = found.limit(1).count() > 0
        if grew:
            edges = found if edges is None else edges.unionByName(found)
            before, labels = labels, components(edges)
            if before is not None:
                drop(before)
        if not drawing:
            drop(*stored)
            return labels
        turn += 1
        drawing = turn < rounds and (grew or turn == 1)


def _n_blocks(entries: int, most: int, spark: SparkSession) -> int:
    """As many blocks as hold ``most`` entries each at most, and more for small inputs, so that all tasks have some, but no fragments."""
    return int(min(MOST_BLOCKS, max(entries // most + 1, min(buckets(spark), entries // LEAST_ENTRIES + 1))))


def _classes(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, sid, n) of each row, and (sid, class, component_id) of each set that is not empty."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # The blocks go straight to their shuffle: reading the texts twice costs less than a stored copy of the matrix.
    info = materialize(set_sizes(docs, width), "sets")
    entries = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = _n_blocks(entries, BLOCK_ENTRIES, spark)
    shared = incidence(docs, n_buckets, width).groupBy("bucket").applyInArrow(_columns(n_buckets), BLOCK_DDL)
    rows = materialize(shared.groupBy("bucket").cogroup(_sizes(info, n_buckets).groupBy("bucket")).applyInArrow(_rows, ROWS_DDL), "rows")
    postings = rows.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    labels = link_classes(rows, _n_blocks(postings, LIST_ENTRIES, spark))
    drop(rows)
    classes = info.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    if labels is None:
        return info, materialize(classes.select("sid", F.col("sid").alias("class"), F.col("least").alias("component_id")), "classes")
    classes = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("root", "sid"))
    least = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = materialize(classes.select("sid", "class").join(least, "class").select("sid", "class", "component_id"), "classes")
    drop(labels)
    return info, named


def similarity_classes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``."""
    info, classes = _classes(docs, width)
    info = info.withColumn("key", F.when(F.col("n") > 0, F.col("sid")))
    return info.join(classes.select(F.col("sid").alias("key"), "component_id"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row of each class with all columns: that of the smallest doc_id, of equal ones that of the least hash of its text.

    Rows without words all stay. A class without any doc_id keeps one row like any other. Of rows that repeat both doc_id and text,
    the one with the least hash of all columns stays.
    """
    info, classes = _classes(docs, width)
    per = info.filter("n > 0").groupBy("sid", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "c")).alias("k")
    keep = materialize(per.join(classes.select("sid", "class"), "sid").groupBy("class").agg(first).select("k.doc_id", "k.th", "k.c"), "keepers")
    drop(info, classes)
    th, num = (_unused(docs, x) for x in ("th", "place"))
    text = F.col("text").cast("string")
    words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(words).withColumn(th, F.xxhash64(text))
    same = marked["doc_id"].cast("long").eqNullSafe(keep["doc_id"]) & (marked[th] == keep["th"])
    once = marked.join(keep.hint("merge"), same, "left_semi")  # the kept ids grow with the table, so they are never broadcast
    if keep.filter("c > 1").limit(1).count():
        one = F.row_number().over(Window.partitionBy("doc_id", th).orderBy(F.xxhash64(*docs.columns)))
        once = once.withColumn(num, one).filter(F.col(num) == 1)
    return once.select(docs.columns).unionByName(docs.filter(~words))


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
