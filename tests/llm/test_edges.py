"""Every operator on documents takes the edge rows and the empty table and returns a row for each row."""

import pytest

from strataloom.llm import jaccard, langid, lm, packing, pii, quality, shards, spbpe
from strataloom.llm.queries import BYTES, PIECES, vocabulary

OPERATORS = {
    "jaccard": jaccard.similarity_classes,
    "quality": lambda d: quality.measure(d, vocabulary(PIECES), vocabulary(BYTES)),
    "langid": langid.identify,
    "spbpe": lambda d: spbpe.digest_documents(d, vocabulary(PIECES)),
    "shards": shards.shard_documents,
    "pii": pii.find,
    "lm": lm.score_documents,
    "packing": lambda d: packing.pack(d, vocabulary(BYTES)).select("doc_id").distinct(),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(name, edge_documents):
    rows = OPERATORS[name](edge_documents).collect()
    assert len(rows) == (11 if name == "packing" else 12)


KEEPERS = {
    "quality": lambda d: quality.keep_documents(d, vocabulary(PIECES), vocabulary(BYTES)),
    "langid": lambda d: langid.keep_documents(d, 0.5),
    "jaccard": jaccard.keep_one,
    "pii": pii.redact,
}
LONG, PROSE = 7, {5, 6}


@pytest.mark.parametrize("name", KEEPERS)
def test_pipeline_forms_keep_all_columns(name, edge_documents, no_documents):
    for df in (edge_documents, no_documents, edge_documents.withColumnsRenamed({"ids": "th", "key": "place"}), edge_documents.withColumnRenamed("ids", "c")):
        got = KEEPERS[name](df)
        assert got.columns == df.columns and got.dtypes == df.dtypes
        if df is no_documents:
            assert got.collect() == []


def test_results_of_edge_rows(edge_documents):
    """The defined results: nulls, texts without words, copies, repeated rows and a null doc_id."""
    words = {r.doc_id: (r.n_words, r.base_failed, r.kept) for r in OPERATORS["quality"](edge_documents).collect()}
    assert words[1] == words[2] == words[3] == (0, True, False) and words[7][0] == 120_000 and not words[5][2]
    classes = {(r.doc_id, r.n_shingles, r.component_id) for r in OPERATORS["jaccard"](edge_documents).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 13, 5), (6, 13, 5), (None, 13, 5), (8, 1, 8)} <= classes
    kept = [r.doc_id for r in KEEPERS["jaccard"](edge_documents).collect()]
    assert sorted(kept) == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    lang = {r.doc_id: (r.lang_pred, r.score) for r in OPERATORS["langid"](edge_documents).collect()}
    assert lang[1] == lang[2] == lang[3] == lang[4] == ("und", 0.0)
    tokens = {r.doc_id: r.n_tokens for r in OPERATORS["spbpe"](edge_documents).collect()}
    assert tokens[1] == tokens[2] == 0 and tokens[7] > 120_000
    spans = {r.doc_id: r.spans for r in OPERATORS["pii"](edge_documents).collect()}
    assert spans[1] == spans[2] == spans[7] == "" and spans[10] == "name:4:14,email:15:21,phone:22:39"
    clean = {r.doc_id: r.text for r in KEEPERS["pii"](edge_documents).collect()}
    assert clean[1] is None and clean[10] == "Dr. [name] [email] [phone]"
    scores = OPERATORS["lm"](edge_documents).collect()
    assert {r.n_tokens for r in scores if r.doc_id in (1, 2, 3)} == {1} and all(r.held_out for r in scores if r.doc_id is None)
    same = [r.score for r in scores if r.doc_id in PROSE or r.doc_id is None]
    assert max(same) - min(same) < 1e-6 * abs(same[0])
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in OPERATORS["shards"](edge_documents).collect()}
    assert sizes[1] == sizes[2] == (16, 0)


def test_classes_without_ids_keep_one_row(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (None, "a b", 3), (4, "x", 4), (4, "y z", 5), (9, "x", 6)], "doc_id long, text string, th int")
    got = jaccard.keep_one(df).collect()
    assert len(got) == 4 and {r.text for r in got} == {text, "a b", "x", "y z"} and {r.doc_id for r in got if r.text == "x"} == {4}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, no_documents):
    assert OPERATORS[name](no_documents).collect() == []
