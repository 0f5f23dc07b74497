"""Queries over texts take them whole."""

from strataloom.functions.scalars import _slug
from strataloom.plans import catalogue


def test_slug_of_the_whole_text(spark, tmp_path):
    texts = {1: "word " * 40 + "Ｅｎｄ", 2: " " * 70 + "late", 3: "a" * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.slug for r in catalogue.QUERIES["slug_nfkc"](spark, str(tmp_path)).collect()}
    assert got == {1: "word-" * 40 + "end", 2: "late", 3: "a" * 5000}
    assert got == {i: _slug(t) for i, t in texts.items()}
