"""Manifests against a tree that is built level by level in memory."""

import hashlib
import zlib

import pytest

from strataloom.llm import merkle


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of each row (doc_id, source, lang, n_chars, text)."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def steps(levels, i):
        out = []
        for nodes in levels[:-1]:
            out.append((i % 3, nodes[i // 3 * 3 : i // 3 * 3 + 3]))
            i //= 3
        return out

    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((H(*map(enc, r)), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    ordered = [sorted(sources[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])) for s in names]
    trees = [tree([h for h, _ in x]) for x in ordered]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (levels, members) in enumerate(zip(trees, ordered, strict=True)):
        for i, (h, r) in enumerate(members):
            way = steps(levels, i) + steps(top, k)
            doc_id, source, lang, n, text = r
            node = H(*map(enc, (doc_id, source, lang, n, text.replace("\n", "")))) if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 else h
            for at, run in way:
                node = H(*run[:at], node, *run[at + 1 :])
            out.append((doc_id or -1, h, levels[-1][0], top[-1][0], H(*[x for at, run in way for j, x in enumerate(run) if j != at]), node))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"s{i % 5}" if i % 3 else "hot", None if i % 5 == 0 else "en", i, f"line {i}\nnext" if i % 4 else None) for i in range(150)]
    out += [(i, None, "de", None, "x\n") for i in range(500, 530)] + [(7, "hot", "en", 7, "again"), (7, "hot", "en", 7, "again"), (None, "hot", None, None, None), (None, "é", "x", 1, "\n"), (900, "Z", "x", 1, "long " * 50_000 + "\n")]
    return out


@pytest.mark.parametrize("levels", [2, 8])
def test_manifest_equals_the_tree_in_memory(spark, rows, levels):
    df = spark.createDataFrame([(*r, "a", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, hash string, place int").repartition(5)
    got = merkle.verified(merkle.manifest(df, levels, merkle.without_line_ends())).collect()
    assert sorted((r.doc_id or -1, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == plain(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and any(r.verified for r in got) and not all(r.verified for r in got)


def test_proofs_hold_for_untouched_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    proofs = merkle.manifest(df, 2)
    for r in proofs.collect():
        assert merkle.fold(r.leaf, r.siblings, r.path) == r.root and r.check == r.leaf


def test_one_row_and_no_rows(spark, no_documents):
    df = spark.createDataFrame([(1, "a", None, None, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    r = merkle.verified(merkle.manifest(df)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root == H("1:1", "1:a", "-", "-", "1:t") and r.proof_sha256 == H("") and r.verified
    assert merkle.verified(merkle.manifest(no_documents)).collect() == []
