"""Runs of repeated words by Lyndon arrays (Ellert and Fischer, "Linear Time Runs over General Ordered Alphabets", 2021).

A run is a stretch of words with smallest period q, at least max(LEAST_LENGTH, LEAST_EXPONENT * q) words long, that no
neighbouring word extends with period q. Every run has Lyndon roots: words that are smaller than their proper suffixes, of
length q, and under one of the two opposite orders of the alphabet each root is the longest Lyndon word at its place. So
``next_smaller`` finds, for both orders, the next smaller suffix of every place and how far the two suffixes match, and a
root whose matches reach far enough is a run. Matches are scanned from left to right and never twice: inside a stretch that
is known to equal an earlier one, a pair of places takes the result of its copy, and only places beyond the stretch are
compared. That makes the scan linear, without suffix arrays and without hashes; words are compared by their number in the
batch, any total order will do.

Most text holds no run, and ``stretches`` leaves it out first, exactly: in a run each word occurs three times or more, and each
window of two, four or eight words twice or more, all inside the document. Counts come from sorting.

``find_runs`` gives documents with their runs and their collapsed text, in which every run keeps only its first period. Defined
results: a null or empty text has no word, no run and an empty collapsed text; a null doc_id is kept; repeated rows are
independent rows; runs that overlap are all found; a very long text is handled whole in its task, in memory linear in its
words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spelling import Spellings
from .store import bounded_batches, give_back
from .words import slices

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
BLOCK = 32

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def next_smaller(t: list[int]) -> tuple[list[int], list[int]]:
    """For each place of ``t`` the start of the next smaller suffix (its length if there is none) and the length of their match.

    Places r are met from left to right; those whose next smaller suffix is still unknown form a chain of previous smaller
    suffixes that begins at r - 1. ``t[seen_from:seen]`` equals the stretch ``shift`` places earlier.
    """
    n = len(t)
    after, match = [n] * n, [0] * n
    before, back = [-1] * n, [0] * n
    seen = seen_from = shift = 0
    for r in range(1, n):
        left, e = r - 1, 0
        while True:
            if left >= seen_from and r < seen:
                copy = left - shift
                e = match[copy] if after[copy] == r - shift else back[r - shift]
                known = e < seen - r
                if not known:
                    e = seen - r
            else:
                known = False
            if not known:
                while t[left + e : left + e + BLOCK] == t[r + e : r + e + BLOCK] and r + e + BLOCK <= n:
                    e += BLOCK
                while r + e < n and t[left + e] == t[r + e]:
                    e += 1
                if r + e >= seen:
                    seen, seen_from, shift = r + e, r, r - left
            if r + e < n and t[r + e] > t[left + e]:
                before[r], back[r] = left, e
                break
            # The suffix at r is smaller: it ends the wait of ``left`` and of all places of the chain that match ``left`` further than r does.
            after[left], match[left] = r, e
            m, left = back[left], before[left]
            while left >= 0 and e < m:
                after[left], match[left] = r, e
                m, left = back[left], before[left]
            if left < 0:
                break
            if e > m:
                before[r], back[r] = left, m
                break
    return after, match


def runs_of(t: np.ndarray, least: int = LEAST_LENGTH, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, by start, then period."""
    found = set()
    place = np.arange(len(t))
    for order in (t, -t.astype(np.int64)):
        after, match = next_smaller(order.tolist())
        period, match = np.asarray(after) - place, np.asarray(match)
        needed = np.maximum(least, exponent * period) - 2 * period + 1  # the first root of a run begins within its first period
        ends = set()
        for i in np.flatnonzero(match >= needed).tolist():
            p = int(period[i])
            end = i + p + int(match[i])
            if (p, end) in ends:
                continue
            ends.add((p, end))
            start = i
            while start:
                w = min(start, max(p, BLOCK))
                other = np.flatnonzero(t[start - w : start] != t[start - w + p : start + p])
                if len(other):
                    start += int(other[-1]) + 1 - w
                    break
                start -= w
            if end - start >= max(least, exponent * p):
                found.add((start, end - start, p))
    return sorted((s, n, p) for s, n, p in found)


def stretches(spelling: np.ndarray, doc: np.ndarray, least: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that can hold a run of at least three periods; every such run lies within one, with its neighbours known to differ."""
    if not len(spelling):
        return []
    _, rank, count = np.unique(doc.astype(np.int64) * (int(spelling.max()) + 1) + spelling, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[rank] >= 3)
    if not len(at):
        return []
    rank = rank[at]
    width = 1
    while True:
        # Keep stretches of neighbouring places whose windows cover ``least`` words.
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
        first, last = np.append(0, cut), np.append(cut, len(at))
        keep = last - first >= least - width + 1
        if width == 8 or not keep.any():
            return [(int(at[a]), int(at[b - 1]) + width) for a, b in zip(first[keep], last[keep], strict=True)]
        mask = np.repeat(keep, last - first)
        stop = np.repeat(last, last - first)
        here = np.flatnonzero(mask & (np.arange(len(at)) + width < stop))
        _, paired, count = np.unique(rank[here].astype(np.int64) * (int(rank.max()) + 1) + rank[here + width], return_inverse=True, return_counts=True)
        twice = count[paired] >= 2
        at, rank, width = at[here[twice]], paired[twice], 2 * width
        if not len(at):
            return []


Rearranged = Callable[[int | None, int], np.ndarray | None]


def planted_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of a document's n words stands at each place after a repeated tail is planted in it; None if it stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % period
    return place


def _slice_runs(batch: pa.RecordBatch, rearranged: Rearranged | None) -> pa.RecordBatch:
    ids, rows = batch.column(0).to_pylist(), batch.num_rows
    w = Spellings(batch.column(1), lower=False)
    total = len(w.starts)
    word = np.arange(total)
    if rearranged is not None:
        for k, doc_id in enumerate(ids):
            a, b = int(w.first[k]), int(w.first[k + 1])
            new = rearranged(doc_id, b - a)
            if new is not None:
                word[a:b] = a + new
    spelling = w.interned()[0][word]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    edge = np.zeros(total + 1, np.int64)
    for a, b in stretches(spelling, w.doc):
        k = int(w.doc[a])
        for start, length, period in runs_of(spelling[a:b]):
            found[k].append((a + start - int(w.first[k]), length, period))
            edge[a + start + period] += 1
            edge[a + start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge)[:total] == 0)
    doc = w.doc[kept]
    tails = np.ones(len(kept), np.int64)
    if len(kept):
        tails[np.append(np.flatnonzero(np.diff(doc)), len(kept) - 1)] = 0
    out, offsets = w.spelled(word[kept], tails)
    texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(offsets[np.searchsorted(doc, np.arange(rows + 1))]), pa.py_buffer(out)).cast(pa.string())
    runs = [[{"start": s, "length": n, "period": p} for s, n, p in sorted(x)] for x in found]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(RUN)), texts], schema=ARROW)


def find_runs(docs: DataFrame, rearranged: Rearranged | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of each document: its runs by start, then period, and its words without what runs repeat, parted by one space.

    ``rearranged(doc_id, n)`` may name, before runs are looked for, which of a document's n words stands at each place.
    """
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _slice_runs(part, rearranged)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run with the greatest exact exponent (ties: smallest start, then period) and digests of ``find_runs``."""
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
