"""Cases in which a shortened job gives a different result."""

from itertools import count

import numpy as np
import pyarrow as pa

from strataloom.llm import jaccard, lm, packing
from strataloom.llm.words import shingle_sets


def test_near_copies_behind_a_longer_document(spark):
    """A document that quotes a passage leads every column in which two near copies of the passage meet, and links with neither."""
    def set_id(words):
        return jaccard.set_id(shingle_sets(pa.array([" ".join(words)]), jaccard.WIDTH)[0])

    passage, common = [f"p{k}" for k in range(60)], [f"q{k}" for k in range(240)]
    y, z = ["y", *passage[1:]], [*passage[:-1], "z"]
    lead = next(x for k in count() if set_id(x := [*passage, f"join{k}", *common]) < min(set_id(y), set_id(z)))
    mostly_alone = [[*common, *(f"m{m}x{k}" for k in range(400))] for m in range(4)]
    texts = [lead, y, z, *mostly_alone]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    linked = {(a, b) for a in range(len(sets)) for b in range(a) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}
    assert linked == {(2, 1)}
    assert {r.doc_id: r.component_id for r in jaccard.similarity_classes(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_model_learns_every_token_once(monkeypatch):
    seen = []
    learn = lm.GatedModel.learn

    def noted(self, h, inputs, targets, rate):
        seen.append(targets[targets >= 0])
        return learn(self, h, inputs, targets, rate)

    monkeypatch.setattr(lm.GatedModel, "learn", noted)
    for n in (0, 1, 95, 5003, 30_011):
        tokens = np.random.default_rng(n).integers(0, 64, n)
        seen.clear()
        m = lm.GatedModel.fresh(np.arange(64)[::-1])
        m.read(tokens, lm.RATE / 2)
        assert sorted(np.concatenate([[], *seen])) == sorted(tokens)


def test_padding_gives_no_gradient():
    a, b = (lm.GatedModel.fresh(np.arange(64)[::-1]) for _ in range(2))
    x, y = np.array([[0, 5, 9, 7]]), np.array([[5, 9, 7, 3]])
    a.learn(np.zeros((1, lm.HIDDEN), np.float32), x, y, 0.1)
    wide = lambda v, fill: np.block([[v, np.full((1, 2), fill)], [np.full((1, 6), fill)]])
    b.learn(np.zeros((2, lm.HIDDEN), np.float32), wide(x, lm.END), wide(y, -1), 0.1)
    assert all(np.allclose(a.p[k], b.p[k], atol=1e-6) for k in a.p)


def test_neighbours_score_all_terms_of_the_seed():
    heavy, light = list(range(100, 130)), list(range(30))
    ids = [np.array(x, np.uint16) for x in (heavy + light, [200, 201], [*light, 300], [202], [203])]
    idf = np.ones(packing.VOCABULARY)
    idf[heavy] = 5
    shard = packing.Shard(ids, idf, 20.0)
    shard.unused[0] = False
    assert next(shard.neighbours(0)) == 2
