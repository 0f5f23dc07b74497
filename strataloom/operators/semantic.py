"""Derivation of the semantic layer: concepts from files, weighted edges from file edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S


def file_concepts(files: DataFrame) -> DataFrame:
    """files(project_id, path, …) with concept_key, concept_label and the relation that ties a file to its concept."""
    name = S.concept_name(F.col("path"), F.col("project_id"))
    return files.withColumn("concept_key", S.slug(name)).withColumn("concept_label", S.humanize(name)).withColumn("relation", S.path_relation(F.col("path")))


def concept_stats(files: DataFrame) -> DataFrame:
    """Per concept: file_count and a language histogram in descending order; files(project_id, concept_key, language)."""
    by = files.groupBy("project_id", "concept_key", "language").agg(F.count(F.lit(1)).alias("n"))
    order = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["language"] < b["language"], -1).when(a["language"] > b["language"], 1).otherwise(0)
    return by.groupBy("project_id", "concept_key").agg(F.sum("n").alias("file_count"), F.array_sort(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "n"))), order).alias("languages"))


def label_pick(titles: DataFrame) -> DataFrame:
    """Display label per concept: the shortest title, documents before other files; titles(concept_key, title, is_document)."""
    ok = titles.filter(F.col("title").isNotNull() & (F.trim("title") != ""))
    return ok.groupBy("concept_key").agg(F.min_by("title", F.struct(F.when(F.col("is_document"), 0).otherwise(1), F.length("title"), "title")).alias("label"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str, limit: int) -> DataFrame:
    """(key, value, place): distinct values of a key by first appearance, at most ``limit`` of each."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_first", value))
    return first.withColumn("place", place).filter(F.col("place") <= limit).select(key, value, "place")


SALTS = 32


def concept_edges(edges: DataFrame, concept_of: DataFrame, evidence: int = 20) -> DataFrame:
    """Concept edges from file edges(source, relation, target) and concept_of(path, concept_key).

    A pair whose relations are all ``references`` is related_to, any other depends_on. Evidence is the first few file edges in
    order. A pair's file edges are dealt over ``SALTS`` parts and move once: each part counts them and keeps its first few, and
    the pair is put together from its parts, so no task sorts a whole pair.
    """
    a = concept_of.select(F.col("path").alias("source"), F.col("concept_key").alias("source_concept"))
    b = concept_of.select(F.col("path").alias("target"), F.col("concept_key").alias("target_concept"))
    keys = ["source_concept", "target_concept"]
    flat = edges.join(a, "source").join(b, "target").filter("source_concept <> target_concept").withColumn("_salt", F.pmod(F.xxhash64("source", "target", "relation"), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt")
    ranked = flat.select(*keys, "source", "target", "relation", F.row_number().over(part.orderBy("source", "target", "relation")).alias("_place"), F.count(F.lit(1)).over(part).alias("_n"), F.min(F.col("relation") == "references").over(part).alias("_only"))
    head = F.col("_place") == 1
    some = F.col("_place") <= max(1, evidence)
    total = ranked.filter(some).groupBy(*keys).agg(F.sum(F.when(head, F.col("_n"))).alias("n"), F.min(F.when(head, F.col("_only"))).alias("only_references"), F.slice(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))), 1, max(1, evidence)).alias("evidence"))
    out = total.select(*keys, F.when(F.col("only_references"), "related_to").otherwise("depends_on").alias("relation"), "n", F.round(S.edge_confidence(F.col("n")), 6).alias("confidence"), "evidence")
    return out if evidence else out.drop("evidence")


KEYWORDS, KEYWORD_LENGTH = 150, 160


def merged_lists(parts: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """keys and values: the distinct values of parts(*keys, place, value) in the order of their first place, at most ``limit`` of a key.

    Repeats go by partial minima and ranks are cut before rows move, so a key's list never stands in one row or one task beyond its limit.
    """
    firsts = parts.groupBy(*keys, "value").agg(F.min("place").alias("place"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "value"))
    kept = firsts.withColumn("_nth", nth).filter(F.col("_nth") <= limit)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "value"))), lambda x: x["value"]).alias("values"))


def concept_keywords(files: DataFrame, existing: DataFrame | None = None, keys: tuple[str, ...] = ("project_id", "concept_key"), limit: int = KEYWORDS) -> DataFrame:
    """keys and keywords of each concept: what it has already, then the entries of its files' metadata lists, files by path and fields in their fixed order.

    files(*keys, path, metadata JSON); existing(*keys, keywords).
    """
    lists = F.array(*[F.struct(F.lit(k).alias("f"), F.from_json(F.get_json_object("metadata", f"$.{name}"), "array<string>").alias("v")) for k, name in enumerate(fixed.KEYWORD_FIELDS)])
    flat = files.select(*keys, "path", F.explode(lists).alias("l")).select(*keys, "path", "l.f", F.posexplode("l.v").alias("i", "v"))
    place = F.struct(F.lit(1).alias("own"), F.col("path"), F.col("f"), F.col("i"))
    parts = flat.filter("trim(v) <> ''").select(*keys, place.alias("place"), F.substring(F.trim("v"), 1, KEYWORD_LENGTH).alias("value"))
    if existing is not None:
        old = existing.select(*keys, F.posexplode("keywords").alias("i", "value")).filter("value <> ''")
        parts = parts.unionByName(old.select(*keys, F.struct(F.lit(0).alias("own"), F.lit("").alias("path"), F.lit(0).alias("f"), F.col("i")).alias("place"), "value"))
    return merged_lists(parts, list(keys), limit).withColumnRenamed("values", "keywords")


def retire(previous: DataFrame, desired: DataFrame) -> DataFrame:
    """Concepts with active and file_count; those no longer wanted stay with active false and no files."""
    gone = previous.join(desired.select("concept_key"), "concept_key", "left_anti").select("concept_key").withColumns({"active": F.lit(False), "file_count": F.lit(0).cast("long")})
    return desired.select("concept_key", F.lit(True).alias("active"), "file_count").unionByName(gone)


def role_counts(files: DataFrame) -> DataFrame:
    """(concept_key, role, n) over the roles of a concept's files."""
    return files.select("concept_key", F.explode("roles").alias("role")).groupBy("concept_key", "role").agg(F.count(F.lit(1)).alias("n"))
