"""Runs by Lyndon arrays against a search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(t, least=24, exponent=3):
    """Every maximal stretch that repeats with its smallest period, found period by period."""
    out = []
    for p in range(1, len(t) // 2 + 1):
        i = 0
        while i + p < len(t):
            j = i
            while j + p < len(t) and t[j] == t[j + p]:
                j += 1
            if j - i >= p and j + p - i >= max(least, exponent * p) and not any(s <= i and j + p <= s + n and p % q == 0 for s, n, q in out):
                out.append((i, j + p - i, p))
            i = max(j, i) + 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.sampled_from([(2, 2), (6, 3), (24, 3)]))
def test_runs_equal_the_search_over_all_periods(t, least):
    assert runs.runs_of(np.array(t, dtype=np.int64), *least) == all_runs(t, *least)


def test_stretches_hold_every_run():
    r = random.Random(3)
    for _ in range(400):
        t = [r.randrange(r.choice([2, 4, 30])) for _ in range(r.randrange(90))]
        for _ in range(2):
            if len(t) > 40:
                p, a = r.randrange(1, 9), r.randrange(len(t) - 30)
                for x in range(a + p, min(len(t), a + 24 + r.randrange(20))):
                    t[x] = t[x - p]
        t = np.array(t, dtype=np.int64)
        got = sorted((a + s, n, p) for a, b in runs.stretches(t, np.zeros(len(t), np.int64)) for s, n, p in runs.runs_of(t[a:b]))
        assert got == all_runs(t.tolist())


def test_next_smaller_compares_each_place_once():
    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    word, longer = [0], [0, 1]
    while len(longer) < 4000:
        word, longer = longer, longer + word
    for t in ([0] * 4000, [k % 7 for k in range(4000)], longer, [random.Random(5).randrange(2) for _ in range(4000)]):
        Counted.seen = 0
        after, match = runs.next_smaller([Counted(x) for x in t])
        assert Counted.seen < 2 * runs.BLOCK * len(t) // 8
        for i in range(0, len(t), 97):
            j = next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t))
            assert after[i] == j


def plain(doc_id, text, planted):
    """Runs and collapsed text of one document by the definition."""
    words = WORD.findall(text or "")
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = all_runs(words)
    dropped = {i for s, k, p in found for i in range(s + p, s + k)}
    return found, " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_documents(spark, edge_documents):
    line = "the same line again "
    rows = [(i, " ".join(f"w{(i * k) % 83}" for k in range(30 + 7 * i))) for i in range(60)] + [(100, "a b " * 20 + line * 12), (101, "x " * 24), (102, "x " * 23), (103, "a " * 30 + "b " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = edge_documents.filter("doc_id IS NULL OR doc_id <> 7").unionByName(df, allowMissingColumns=True)
    for planted in (None, runs.planted_tail):
        found = runs.find_runs(docs, planted)
        got = sorted((r.doc_id or -1, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
        assert got == sorted((r.doc_id or -1, *plain(r.doc_id, r.text, planted)) for r in docs.collect())
        for r, d in zip(found.orderBy("doc_id", "collapsed").collect(), runs.digests(found).orderBy("doc_id", "collapsed_sha256").collect(), strict=True):
            del r
            assert (d.n_runs == 0) == (d.start is None)
        by_text = {hashlib.sha256(r.collapsed.encode()).hexdigest(): r.runs for r in found.collect()}
        for d in runs.digests(found).collect():
            best = min(by_text[d.collapsed_sha256], key=lambda x: (-Fraction(x.length, x.period), x.start, x.period), default=None)
            assert d.runs_sha256 == hashlib.sha256("".join(f"{x.start},{x.length},{x.period}\n" for x in by_text[d.collapsed_sha256]).encode()).hexdigest()
            if best is not None:
                assert (d.start, d.length, d.period, d.exponent_milli) == (*best, 1000 * best.length // best.period)


def test_very_long_text_and_no_documents(spark, edge_documents, no_documents):
    long = edge_documents.filter("doc_id = 7")
    r = runs.find_runs(long).first()
    assert [tuple(x) for x in r.runs] == [(0, 120_000, 1954)] and len(r.collapsed.split()) == 1954
    assert runs.digests(runs.find_runs(no_documents)).collect() == []
