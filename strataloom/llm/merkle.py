"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and a proof for each row.

A tree reduces every ``FANOUT`` consecutive nodes to their hash until one is left. Places are bucketed by FANOUT**LEVELS:
``applyInPandas`` collapses a bucket by LEVELS levels at once and gives each of its nodes the proof up to the bucket's root;
the roots of all buckets are the nodes of the next round, and so on. A row's proof is the proof within its bucket followed by
those of the buckets' roots. A bucket holds FANOUT**LEVELS nodes at most, so a source of any size is split over tasks.

Places come from a range sort by (source, doc_id): a row's place is its place in its partition plus the rows of its source in
earlier partitions, so no task sees a whole source.

Defined results: a null field is hashed as ``-``; a null source is a source of its own and comes first; a null doc_id comes
first within its source; rows that share a doc_id stand in the order of their leaves, and equal rows are neighbouring equal
leaves; a very long text is hashed by the engine and never leaves it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import materialize

FANOUT, LEVELS = 3, 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*inputs: str) -> str:
    """Lower-case hex SHA-256 of the concatenated inputs."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def encoded(field: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its length in UTF-8 bytes, a colon and its value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The hash of a row; ``text`` takes the place of its text."""
    return F.sha2(F.concat(*[encoded(text if text is not None and f == "text" else F.col(f)) for f in FIELDS]), 256)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, from 0 within their group by ``order``, and ``total``, the rows of the group; written to the shared folder on the way."""
    place = F.monotonically_increasing_id()
    laid = materialize(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", place), name)
    laid_part = laid.withColumn("_part", F.shiftright("_at", 33))
    parts = laid_part.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    parts = parts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), "_least", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return laid_part.join(parts, same).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_least")).alias("place"), "total")


def levels_of(total: int) -> int:
    """Levels that a tree of ``total`` leaves has above them."""
    n = 0
    while total > 1:
        total, n = -(-total // FANOUT), n + 1
    return n


def collapse(hashes: list[str], levels: int) -> tuple[str, list[str], list[str]]:
    """(root, siblings, path) of consecutive nodes after ``levels`` levels.

    A node's siblings are the digests of the others of its runs, level by level, from left to right; its path has two digits a
    level: its place in its run and the run's size.
    """
    rounds, nodes = [], hashes
    for _ in range(levels):
        runs = [nodes[i : i + FANOUT] for i in range(0, len(nodes), FANOUT)]
        rounds.append(runs)
        nodes = [digest(*run) for run in runs]
    if len(nodes) != 1:
        raise ValueError("a bucket holds more nodes than its levels reduce to one")
    siblings, path = [""], [""]
    for runs in reversed(rounds):
        siblings = ["".join(run[:k] + run[k + 1 :]) + siblings[i] for i, run in enumerate(runs) for k in range(len(run))]
        path = [f"{k}{len(run)}{path[i]}" for i, run in enumerate(runs) for k in range(len(run))]
    return nodes[0], siblings, path


def fold(node: str, siblings: str, path: str) -> str:
    """The root that ``node`` leads to by its proof."""
    at = 0
    for i in range(0, len(path), 2):
        k, n = int(path[i]), int(path[i + 1])
        run = siblings[at : at + 64 * (n - 1)]
        node, at = digest(run[: 64 * k], node, run[64 * k :]), at + 64 * (n - 1)
    return node


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes(tree, place, total, hash, ...) with bucket, bucket_root, siblings and path, all within their bucket of ``levels`` levels."""
    size = FANOUT**levels

    def each(bucket: pd.DataFrame) -> pd.DataFrame:
        bucket = bucket.sort_values("place", ignore_index=True)
        root, siblings, path = collapse(bucket["hash"].tolist(), min(levels, levels_of(int(bucket["total"].iloc[0]))))
        return bucket.assign(bucket_root=root, siblings=siblings, path=path)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    keyed = nodes.withColumn("bucket", F.expr(f"place div {size}"))
    return keyed.groupBy("tree", "bucket").applyInPandas(each, f"{schema}, bucket long, bucket_root string, siblings string, path string")


def trees(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Proofs of all nodes(tree, place, total, hash, ...) up to their tree's root: the same columns with root, siblings and path.

    tree, place and total are longs that are not null; further columns must be strings. Two bucket rounds cover FANOUT**(2 * LEVELS) leaves.
    """
    lower = materialize(_reduced(nodes, levels), "merkle")
    most = lower.agg(F.max("total")).first()[0] or 0
    if most <= FANOUT**levels:
        return lower.withColumnRenamed("bucket_root", "root").drop("bucket")
    size = FANOUT**levels
    roots = lower.filter(F.col("place") % size == 0).select("tree", F.col("bucket").alias("place"), F.expr(f"(total + {size - 1}) div {size}").alias("total"), F.col("bucket_root").alias("hash"))
    upper = trees(roots, levels).select("tree", F.col("place").alias("bucket"), "root", F.col("siblings").alias("_siblings"), F.col("path").alias("_path"))
    joined = lower.drop("bucket_root").join(upper, ["tree", "bucket"])
    return joined.withColumns({"siblings": F.concat("siblings", "_siblings"), "path": F.concat("path", "_path")}).drop("_siblings", "_path", "bucket")


def manifest(docs: DataFrame, levels: int = LEVELS, check: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings and path of each row of documents, and ``check``, the hash of a row to be verified (its leaf, if null).

    ``check`` is an expression over the columns of docs; siblings and path lead from the leaf by its source's subroot to the root.
    """
    base = docs.select(*[F.col(f) for f in FIELDS])
    hashed = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf().alias("hash"), (F.lit(None).cast("string") if check is None else check).alias("check"))
    placed = numbered(hashed, ["source"], ["doc_id", "hash"], "leaves")
    sources = numbered(placed.groupBy("source").agg(F.first("total").alias("n")), [], ["source"], "sources")
    sources = sources.select(F.col("source").alias("_source"), F.col("place").alias("tree"), F.col("total").alias("_sources"))
    leaves = placed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "place", F.col("total").cast("long").alias("total"), "hash", F.col("doc_id").cast("string").alias("doc_id"), "check", F.col("_sources").cast("string").alias("sources"))
    low = trees(leaves, levels)
    heads = low.filter("place = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("sources").cast("long").alias("total"), F.col("root").alias("hash"))
    top = trees(heads, levels).select(F.col("place").alias("tree"), F.col("root").alias("_root"), F.col("siblings").alias("_siblings"), F.col("path").alias("_path"))
    return low.join(top, "tree").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("siblings", "_siblings").alias("siblings"), F.concat("path", "_path").alias("path"), F.coalesce("check", "hash").alias("check"))


def verified(proofs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: ``check`` folded up by each proof, against the root."""
    fields = ["doc_id", "leaf", "subroot", "root", "siblings", "path", "check"]
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            siblings, path, check = (batch.column(k).to_pylist() for k in (4, 5, 6))
            proof = [digest(x) for x in siblings]
            folded = [fold(*x) for x in zip(check, siblings, path, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)] + [pa.array(proof, pa.string()), pa.array(folded, pa.string())], schema=schema)

    out = proofs.select(*fields).mapInArrow(each, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends() -> Column:
    """The leaf that a row has after its line ends are deleted, where 2 divides the CRC-32 of its doc_id; else null."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))))
