"""Hops, lookups and upserts over nodes(id, project_id, layer, kind, key, label, …) and edges(source_id, relation, target_id, …)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbors(edges: DataFrame, nodes: DataFrame, of: Column) -> DataFrame:
    """Out and in neighbours of the nodes that ``of`` (a condition on the column node) selects: node, direction, relation, neighbor, key, label."""
    ends = nodes.select(F.col("id").alias("neighbor"), "key", "label")
    out = edges.select(F.col("source_id").alias("node"), F.lit("out").alias("direction"), "relation", F.col("target_id").alias("neighbor"))
    back = edges.select(F.col("target_id").alias("node"), F.lit("in").alias("direction"), "relation", F.col("source_id").alias("neighbor"))
    return out.filter(of).unionByName(back.filter(of)).join(ends, "neighbor").select("node", "direction", "relation", "neighbor", "key", "label")


def targets(edges: DataFrame, nodes: DataFrame, layer: int | None = None) -> DataFrame:
    """Each edge with the key of its target; only targets of a layer if one is named."""
    ends = nodes if layer is None else nodes.filter(F.col("layer") == layer)
    return edges.join(ends.select(F.col("id").alias("target_id"), "key", "label"), "target_id").select("source_id", "relation", "target_id", "key", "label")


def sources_of(nodes: DataFrame, edges: DataFrame, target: Column) -> DataFrame:
    """Distinct nodes with an edge into the selected targets: a semi-join, so nothing is made distinct afterwards."""
    return nodes.join(edges.filter(target).select(F.col("source_id").alias("id")), "id", "left_semi")


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge names at either end: two anti-joins, as an OR in one would become a nested loop."""
    return nodes.join(edges.select(F.col("source_id").alias("id")), "id", "left_anti").join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ("created_at",)) -> DataFrame:
    """New rows replace old ones of the same natural key but keep the old values of ``keep``; ``new`` has at most one row a key."""
    kept = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep])
    merged = new.join(kept, list(keys), "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(merged)


def impact(paths: DataFrame, edges: DataFrame, selector: str) -> DataFrame:
    """In and out edges of one file: the exact path, else the only path that contains the selector; nothing if there is none or more (``reports.file_impact`` says which)."""
    found = paths.filter(F.contains(F.lower("path"), F.lit(selector.lower()))).select("path", (F.col("path") == selector).alias("exact"))
    one = found.agg(F.max(F.when(F.col("exact"), F.col("path"))).alias("e"), F.count(F.lit(1)).alias("n"), F.min("path").alias("p"))
    chosen = one.select(F.coalesce("e", F.when(F.col("n") == 1, F.col("p"))).alias("path")).filter(F.col("path").isNotNull())
    out = edges.join(chosen.withColumnRenamed("path", "source"), "source", "left_semi").select(F.lit("out").alias("direction"), "relation", F.col("target").alias("path"))
    back = edges.join(chosen.withColumnRenamed("path", "target"), "target", "left_semi").select(F.lit("in").alias("direction"), "relation", F.col("source").alias("path"))
    return out.unionByName(back)


def longest_owner(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The deepest root above each path: ancestors are enumerated and met by an equi-join, so no range join is needed."""
    parts = F.split("path", "/")
    above = paths.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))))
    hit = above.join(roots, "root").groupBy("path").agg(F.max_by("root", F.struct(F.length("root"), "root")).alias("root"))
    return paths.join(hit, "path", "left")
