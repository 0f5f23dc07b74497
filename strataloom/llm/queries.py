"""Queries op1 to op13: each applies one operator to its whole table. ORACLES has the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..runtime import importable, table
from . import decontaminate, jaccard, langid, lm, merkle, packing, pii, quality, runs, shards, spbpe, topk, warc


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the folder may be named in the environment."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_warc_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    _, records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return quality.measure(table(spark, sf_dir, "documents"), vocabulary(PIECES), vocabulary(BYTES))


def op4_language_id_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_exact_topk_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spbpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op7_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op8_pii_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return pii.find(table(spark, sf_dir, "documents"))


def op9_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op10_lexical_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTES)).drop("ids")


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return runs.digests(runs.find_runs(table(spark, sf_dir, "documents"), runs.planted_tail))


def op12_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return decontaminate.digests(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op13_merkle_superblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), check=merkle.without_line_ends()))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_seekable_bundles, op2_ngram_jaccard_join, op3_tokeniser_fertility, op4_language_id_ftrl, op5_exact_topk_impact_index, op6_sentencepiece_prefix_table, op7_balanced_label_propagation,
        op8_pii_random_field, op9_gated_language_model, op10_lexical_retrieval_packing, op11_lyndon_runs, op12_fm_index_decontamination, op13_merkle_superblocks,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
# CRC-32 by its bits; the last complement turns an odd remainder into an even checksum.
_EVEN_CRC = """(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CAST(3988292384 AS UBIGINT) * (v & 1)))) & 1) = 1"""

ORACLES = {
    "op1_warc_seekable_bundles": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
        FROM k
    """,
    "op5_exact_topk_impact_index": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_fm_index_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS words FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(s) WHERE len(w) > 0),
        kinds AS (SELECT DISTINCT k FROM g),
        places AS (SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS words FROM d, kinds, unnest(range(1, len(w) - k + 2)) t(s)),
        found AS (SELECT r, s, places.k, item_id FROM places JOIN g ON places.k = g.k AND places.words = g.words),
        hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM found)) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """,
    "op13_merkle_superblocks": f"""
        WITH RECURSIVE leaves AS (
            SELECT row_number() OVER () AS r, doc_id, source, {_LEAF.format("text")} AS leaf, CASE WHEN {_EVEN_CRC} THEN {_LEAF.format("replace(text, chr(10), '')")} END AS tampered FROM documents),
        sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
        placed AS (SELECT r, doc_id, leaf, coalesce(tampered, leaf) AS again, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total
                   FROM leaves JOIN sources ON leaves.source IS NOT DISTINCT FROM sources.source),
        up(lvl, tree, place, h, n) AS (
            SELECT 0, tree, place, leaf, total FROM placed
            UNION ALL SELECT lvl + 1, tree, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY lvl, tree, place // 3),
        subroots AS (SELECT tree, lvl AS height, h AS subroot FROM up WHERE n = 1),
        top(lvl, place, h, n) AS (
            SELECT 0, tree, subroot, (SELECT count(*) FROM sources) FROM subroots
            UNION ALL SELECT lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, place // 3),
        runs AS (
            SELECT lvl, tree, place // 3 AS run, list(h ORDER BY place) AS hs FROM up WHERE n > 1 GROUP BY ALL
            UNION ALL SELECT lvl + height, tree, run, hs FROM (SELECT lvl, place // 3 AS run, list(h ORDER BY place) AS hs FROM top WHERE n > 1 GROUP BY ALL) t
                JOIN (SELECT tree, height, tree AS spot FROM subroots) s ON t.run = s.spot // CAST(pow(3, t.lvl + 1) AS BIGINT)),
        fold(lvl, r, tree, spot, h, proof) AS (
            SELECT 0, r, placed.tree, CASE WHEN height = 0 THEN placed.tree ELSE place END, again, '' FROM placed JOIN subroots USING (tree)
            UNION ALL SELECT fold.lvl + 1, fold.r, fold.tree, CASE WHEN fold.lvl + 1 = height THEN fold.tree ELSE fold.spot // 3 END,
                sha256(array_to_string(hs[1 : fold.spot % 3], '') || fold.h || array_to_string(hs[fold.spot % 3 + 2 : 3], '')), proof || array_to_string(hs[1 : fold.spot % 3], '') || array_to_string(hs[fold.spot % 3 + 2 : 3], '')
            FROM fold JOIN subroots ON fold.tree = subroots.tree JOIN runs ON runs.lvl = fold.lvl AND runs.tree = fold.tree AND runs.run = fold.spot // 3),
        done AS (SELECT r, arg_max(h, lvl) AS folded_root, arg_max(proof, lvl) AS proof FROM fold GROUP BY r)
        SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = (SELECT h FROM top WHERE n = 1) AS verified
        FROM placed JOIN subroots USING (tree) JOIN done USING (r)
    """,
}
