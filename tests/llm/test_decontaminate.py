"""Decontamination by FM-indexes against a search of every window at every place."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataloom.llm import decontaminate as D
from strataloom.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    windows = [(i, tuple(w[k : k + window])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for doc_id, text in docs:
        w, hit, ids, spans = words(text), set(), set(), []
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    ids |= {i} - {None}
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((doc_id or -1, len(w), [tuple(x) for x in spans], sorted(ids, key=str)))
    return sorted(out)


@pytest.mark.parametrize("symbols", [1, 2, 5, 40])
def test_search_and_locate_find_every_occurrence(symbols):
    r = random.Random(symbols)
    for _ in range(40):
        docs = [[r.randrange(symbols) for _ in range(r.choice([0, 1, 5, 30, 70]))] for _ in range(r.randint(1, 8))]
        docs.append(list(docs[0]))
        spellings = pa.array([str(k).encode() for k in range(symbols)], pa.large_binary())
        built = fmindex.FMIndex.build(np.array([x for d in docs for x in d], dtype=np.int64), np.array([len(d) for d in docs]), spellings, sample=r.choice([1, 4, 16]))
        index = fmindex.FMIndex.from_bytes(built.to_bytes())
        phrases = [[r.randrange(symbols + 1) for _ in range(r.randint(1, 6))] for _ in range(20)] + [d[1:5] for d in docs if len(d) > 4]
        sizes = np.array([len(p) for p in phrases])
        low, high = index.search(np.array([0 if x >= symbols else x + 1 for p in phrases for x in p]), np.cumsum(sizes) - sizes, sizes)
        for p, a, b in zip(phrases, low, high, strict=True):
            place = index.locate(np.arange(a, b))
            doc = np.searchsorted(index.starts, place, side="right") - 1
            assert sorted(zip(doc.tolist(), (place - index.starts[doc]).tolist(), strict=True)) == [(d, k) for d, w in enumerate(docs) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(9)
    prose = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    passage = prose(40)
    items = [(1, passage), (2, "W1, w2!"), (3, ""), (4, None), (5, "!!"), (6, prose(10)), (6, prose(12)), (7, passage[60:]), (None, prose(11)), (8, "é日本 w5"), (9, "a b" * 400)]
    docs = [(k, prose(r.randrange(80))) for k in range(60)]
    docs += [(100 + k, f"{prose(7)} {passage.upper()} {prose(5)}") for k in range(40)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, items[5][1]), (203, items[6][1] + " " + items[6][1]), (204, "\x00É日本-W5 é日本 w5"), (205, items[8][1]), (205, items[8][1]), (206, prose(9000) + " " + passage), (207, "a b" * 150)]
    return docs, items


@pytest.mark.parametrize("shard_bytes,block_bytes", [(D.SHARD_BYTES, D.BLOCK_BYTES), (900, 300)])
def test_documents(spark, corpus, shard_bytes, block_bytes):
    docs, items = corpus
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, shard string, place int").repartition(3)
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    found = D.decontaminate(df, bench, shard_bytes=shard_bytes, block_bytes=block_bytes)
    want = plain(docs, items)
    assert sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.spans], sorted(r["items"], key=str)) for r in found.collect()) == want
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.digests(found).collect())
    assert got == sorted((i, n, sum(b - a for a, b in spans), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(spans)) for i, n, spans, ids in want)


def test_long_items_are_cut_without_losing_windows(spark):
    text = " ".join(f"v{k % 71}" for k in range(500))
    parts = [r.text.split() for r in D.item_parts(spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "item_id long, text string"), 10, 64).collect()]
    cut = {tuple(p[k : k + 10]) for p in parts if len(p) >= 10 for k in range(len(p) - 9)}
    w = text.split()
    assert cut == {tuple(w[k : k + 10]) for k in range(491)} and ["a", "b"] in parts


def test_edge_documents_and_empty_tables(spark, edge_documents, no_documents):
    bench = spark.createDataFrame([(1, "the cat and the dog went to the old house by"), (2, "und"), (3, "日本語")], "item_id long, text string")
    got = {(r.doc_id, r.n_hit) for r in D.digests(D.decontaminate(edge_documents, bench)).collect()}
    assert {(1, 0), (2, 0), (3, 0), (4, 0), (5, 11), (6, 11), (7, 60_000), (8, 0), (9, 1), (None, 11), (10, 0)} == got
    assert D.decontaminate(no_documents, bench).collect() == []
    assert D.decontaminate(edge_documents, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
