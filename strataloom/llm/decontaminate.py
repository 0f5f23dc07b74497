"""Benchmark decontamination by an FM-index for each shard of the training documents.

A shard is SHARD_BYTES of consecutive texts of one partition and has its index (``fmindex``) as one row of a stored table, which
serves any number of test sets. Test items are cut into windows of WINDOW words (an item of fewer is one window), and every
window is searched in every shard: backward search gives the rows of its suffixes, sampled positions give their places, and
the stretches of all occurrences in a document are merged into its removal spans. Windows go to the shards in blocks of at most
BLOCK_BYTES, one pass over the index table for each block, so what a task holds besides its shard is bounded for test sets of any size.

Words are made of digits, letters a to z after A to Z are lowered, and characters beyond ASCII. Defined results: a null or empty
text has no word; a null doc_id is kept; repeated rows are documents of their own; an item without words is never found; items that share an
item_id are one item, and an item without item_id marks words but is not counted or listed; a text is never cut, so a very long
one makes a shard of its own; an empty table of documents gives no rows, an empty test set marks nothing; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fmindex import FMIndex
from .spelling import Spellings, mapped
from .store import bounded_batches, give_back, materialize
from .words import LOWER, slices, text_buffer

WINDOW = 10
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
PART_WORDS = 1 << 16
ROWS_AT_ONCE = 1 << 18

# What is left of each byte: digits, lowered letters and characters beyond ASCII; the rest parts words.
KEPT = np.full(256, 0x20, np.uint8)
KEPT[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = LOWER[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]]


def words_of(column: pa.Array) -> Spellings:
    return Spellings(mapped(column, KEPT), lower=False)


SHARD_SCHEMA = "shard string, doc_id array<long>, n_words array<long>, content binary"
HIT_SCHEMA = "shard string, place long, start long, end long, item_id array<long>"


def _index(name: str, texts: list[pa.Array], ids: list[pa.Array]) -> pa.RecordBatch:
    w = words_of(pa.chunked_array(texts).combine_chunks() if len(texts) > 1 else texts[0])
    spelling, spellings = w.interned()
    content = FMIndex.build(spelling, w.counts, spellings).to_bytes()
    doc_id = pa.ListArray.from_arrays(pa.array([0, len(w.counts)], pa.int32()), pa.chunked_array(ids).combine_chunks())
    n_words = pa.ListArray.from_arrays(pa.array([0, len(w.counts)], pa.int32()), pa.array(w.counts, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([name]), doc_id, n_words, pa.array([content], pa.binary())], ["shard", "doc_id", "n_words", "content"])


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a shard: its name, its documents with their numbers of words, and its FM-index; written to the shared folder."""
    bounded_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size = TaskContext.get().partitionId(), 0, 0
        texts: list[pa.Array] = []
        ids: list[pa.Array] = []
        for batch in batches:
            for part in slices(batch, "text", shard_bytes // 4):
                texts.append(part.column(1).cast(pa.large_string()))
                ids.append(part.column(0))
                size += len(text_buffer(texts[-1])[0])
                if size >= shard_bytes:
                    yield _index(f"{task:06d}-{made:06d}", texts, ids)
                    texts, ids, made, size = [], [], made + 1, 0
        if texts:
            yield _index(f"{task:06d}-{made:06d}", texts, ids)
        give_back()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(base.mapInArrow(each, SHARD_SCHEMA), "fm-index")


class Phrases:
    """Windows of test items: all words in a row, and of each window its start, its size and its item."""

    def __init__(self, items: pa.Table, window: int = WINDOW):
        w = words_of(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()))
        self.words, self.spellings = w.interned()
        self.items = items.column("item_id").combine_chunks()
        n = w.counts
        windows = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        self.item = np.repeat(np.arange(len(n)), windows)
        within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = w.first[:-1][self.item] + within
        self.size = np.minimum(n, window)[self.item]


def search_shard(index: FMIndex, phrases: Phrases) -> Iterator[tuple[int, int, int, list[int]]]:
    """(document, first word, word after the last, items) of the merged removal spans of a shard; all items of a document come with its first span."""
    if not len(phrases.start):
        return
    symbol = index.symbols(phrases.spellings)[phrases.words]
    low, high = index.search(symbol, phrases.start, phrases.size)
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    # Windows of equal words have equal rows: each set of rows is located once, in chunks of rows.
    kinds, which = np.unique(np.stack([low[found], high[found], phrases.size[found]], 1), axis=0, return_inverse=True)
    owned = np.unique(which.reshape(-1) * len(phrases.items) + phrases.item[found])
    owner, owners = owned % len(phrases.items), np.searchsorted(owned, np.arange(len(kinds) + 1) * len(phrases.items))
    until = np.cumsum(kinds[:, 1] - kinds[:, 0])
    cover = np.zeros(int(index.starts[-1]) + 1, np.int64)
    met = []
    for begin in range(0, int(until[-1]), ROWS_AT_ONCE):
        nth = np.arange(begin, min(int(until[-1]), begin + ROWS_AT_ONCE))
        kind = np.searchsorted(until, nth, side="right")
        place = index.locate(kinds[kind, 1] - (until[kind] - nth))
        cover += np.bincount(place, minlength=len(cover)) - np.bincount(place + kinds[kind, 2], minlength=len(cover))
        met.append(np.unique((np.searchsorted(index.starts, place, side="right") - 1) * len(kinds) + kind))
    met = np.unique(np.concatenate(met))
    in_doc, kind = met // len(kinds), met % len(kinds)
    each = owners[kind + 1] - owners[kind]
    item = owner[np.repeat(owners[kind] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
    pairs = np.unique(np.repeat(in_doc, each) * len(phrases.items) + item)
    in_doc, item = pairs // len(phrases.items), pairs % len(phrases.items)
    edge = np.diff(np.append(0, (np.cumsum(cover) > 0).astype(np.int8)))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc, said = np.searchsorted(index.starts, start, side="right") - 1, -1
    for d, s, e in zip(doc.tolist(), (start - index.starts[doc]).tolist(), (end - index.starts[doc]).tolist(), strict=True):
        ids: list[int] = []
        if d != said:
            ids = [x for x in phrases.items.take(pa.array(item[np.searchsorted(in_doc, d) : np.searchsorted(in_doc, d + 1)])).to_pylist() if x is not None]
        said = d
        yield d, s, e, ids


def item_parts(items: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """Distinct (item_id, text) with long items cut: each part holds the words of ``part_words`` windows, so that the parts have the windows of the whole."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column(1))
                row, text = [], []
                for k, n in enumerate(w.counts.tolist()):
                    for at in range(0, max(n - window + 1, min(n, 1)), part_words):
                        a, b = int(w.first[k]) + at, int(w.first[k]) + min(n, at + part_words + window - 1)
                        row.append(k)
                        text.append(w.data[w.starts[a] : w.ends[b - 1]].tobytes().decode())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(text, pa.string())], ["item_id", "text"])

    held = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(each, "item_id long, text string").distinct()


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[pa.Table]:
    """The windows of the test set in blocks of at most ``block_bytes`` or one part; the driver holds one at a time.

    Parts are hashed into bins until each bin fits; bins are put together as long as they fit a block.
    """
    parts = item_parts(items, window).withColumn("_size", F.octet_length("text") + 8)
    n = 1
    while True:
        bin_ = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        sizes = parts.groupBy(bin_.alias("bin")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("parts")).orderBy("bin").collect()  # a row for each block or so
        worst = max((r["size"] for r in sizes if r["parts"] > 1), default=0)
        if worst <= block_bytes:
            break
        n *= max(2, math.ceil(worst / block_bytes))
    block, size = [], 0
    for r in [*sizes, None]:
        if block and (r is None or size + r["size"] > block_bytes):
            yield parts.filter(bin_.isin(block)).select("item_id", "text").toArrow()
            block, size = [], 0
        if r is not None:
            block, size = [*block, r["bin"]], size + r["size"]


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Merged removal spans: shard, place (of the document in it), start, end (in words, end exclusive) and, with a document's first span of a block, its item_ids."""
    out = None
    for block in _blocks(items, window, block_bytes):

        def each(batches: Iterator[pa.RecordBatch], block: pa.Table = block) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(block, window)
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows = [(name, *x) for x in search_shard(FMIndex.from_bytes(content.as_py()), phrases)]
                    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "place", "start", "end", "item_id"])
            give_back()

        hits = index.select("shard", "content").mapInArrow(each, HIT_SCHEMA)
        out = hits if out is None else out.unionByName(hits)
    return index.sparkSession.createDataFrame([], HIT_SCHEMA) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, spans (merged, in words, end exclusive) and items (distinct item_ids) of each document."""
    index = build_index(docs, shard_bytes)
    hits = search(index, items, window, block_bytes)
    # Spans of several blocks may meet: a span that begins within what came before it in its document belongs to that.
    before = Window.partitionBy("shard", "place").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = hits.withColumn("_new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("_span", F.sum("_new").over(before))
    whole = numbered.groupBy("shard", "place", "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_list("item_id")).alias("ids"))
    one = whole.groupBy("shard", "place").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("items"))
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("place", "d")).select("shard", F.col("place").cast("long").alias("place"), "d.doc_id", "d.n_words")
    none = lambda t: F.array().cast(t)
    return listed.join(one, ["shard", "place"], "left").select("doc_id", "n_words", F.coalesce("spans", none("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", none("array<long>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of ``decontaminate`` and the digest of each document's item_ids, sorted as strings."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
