"""The context of many queries in one plan: terms of all queries meet the nodes by the gram index, and everything is ranked by query.

``search.context`` answers one query; here each step is one join for all of them, so a suite of any number of cases costs one
plan. Lists of a query are cut by ranks within the query, which the engine limits before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S
from ..runtime import stored
from . import grams
from .search import HOP_CONCEPTS, HOP_FILES

SEEDS = 40


def first(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key in a total order, with their place from 1."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= limit)


def query_terms(queries: DataFrame) -> DataFrame:
    """(case_key, term, whole) of queries(case_key, query): each term, and whether it is the whole query."""
    q = queries.select("case_key", S.search_terms_column(F.col("query")).alias("terms"), F.lower(F.trim(F.regexp_replace("query", r"\s+", " "))).alias("q"))
    return q.select("case_key", F.explode("terms").alias("term"), "q").select("case_key", "term", (F.col("term") == F.col("q")).alias("whole"))


def scored(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(case_key, id, score) of every node that a query's terms or its concept names reach; nodes(id, layer, kind, key, label, data, active, aliases)."""
    concept = (F.col("layer") == 2) & (F.col("kind") == "concept")
    inactive = concept & ~F.coalesce("active", F.lit(True))
    text = nodes.select("id", F.concat_ws("\x00", F.lower("label"), F.lower("key"), F.lower(F.coalesce("data", F.lit("")))).alias("text"))
    # Each step is written, so no plan grows with the steps before it and the driver holds none that does.
    terms = stored(query_terms(queries), "terms")
    sought = terms.select(F.col("term").alias("pattern"))
    held = stored(grams.containing(text, sought, grams.asked(text, sought)), "held").withColumnRenamed("pattern", "term")
    label, key, data, term = F.lower("label"), F.lower("key"), F.lower("data"), F.col("term")
    inside = lambda c, x: F.when(F.contains(c, term), x).otherwise(0.0)
    part = F.when(label == term, 9.0).otherwise(inside(label, 5.0)) + F.when(key == term, 6.0).otherwise(inside(key, 3.0)) + inside(data, 1.0) + F.when(F.col("whole"), inside(label, 12.0) + inside(key, 8.0)).otherwise(0.0)
    hit = held.join(nodes.select("id", "label", "key", "data"), "id").join(terms, "term").groupBy("case_key", "id").agg(F.sum(F.coalesce(part, F.lit(0.0))).alias("part"))
    # The other way round: active concepts one of whose names stands in the query.
    names = nodes.filter(concept & ~inactive).select("id", F.explode(F.concat(F.array("label", "key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("id", F.lower(F.trim("n")).alias("pattern")).filter(F.length("pattern") >= 2)
    wholes = terms.filter("whole").select(F.col("case_key").alias("id"), F.col("term").alias("text"))
    named = grams.containing(wholes, names.select("pattern")).select(F.col("id").alias("case_key"), "pattern").join(names, "pattern").select("case_key", "id").distinct()
    every = hit.unionByName(named.withColumn("part", F.lit(0.0))).groupBy("case_key", "id").agg(F.sum("part").alias("part"))
    base = F.lit(1.0)
    for layer, value in fixed.LAYER_SCORES.items():
        base = F.when(F.col("layer") == layer, F.lit(value)).otherwise(base)
    return every.join(nodes.select("id", "layer", "kind", "key", "label", (base - F.when(inactive, 6.0).otherwise(0.0)).alias("base")), "id").select("case_key", "id", "layer", "kind", "key", "label", (F.col("base") + F.col("part")).alias("score"))


def contexts(queries: DataFrame, nodes: DataFrame, edges: DataFrame, concept_limit: int = 5, file_limit: int = 12) -> dict[str, DataFrame]:
    """concepts(case_key, place, id, key, label), files(case_key, place, path) and neighbors of queries(case_key, query) with terms.

    As in ``search.context``: the best nodes; concepts among them, then concepts of the files among them; files found, then those of
    the concepts, then the first files of the first neighbours.
    """
    # Few rows a query, read by several joins: they are written once.
    best = stored(first(scored(queries, nodes), ["case_key"], [F.desc("score"), F.col("label"), F.col("id")], SEEDS), "seeds")
    files = best.filter("layer = 1 AND kind = 'file'")
    direct = best.filter("layer = 2 AND kind = 'concept'").select("case_key", "id", F.lit(0).alias("p"), "score")
    through = edges.join(files.select("case_key", F.col("id").alias("target_id"), "score"), "target_id").select("case_key", F.col("source_id").alias("id"), F.lit(1).alias("p"), "score")
    concept_nodes = nodes.filter("layer = 2 AND kind = 'concept'").select("id", "key", "label")
    ranked = direct.unionByName(through).groupBy("case_key", "id").agg(F.min(F.struct("p", (-F.col("score")).alias("s"))).alias("r")).join(concept_nodes, "id")
    concepts = stored(first(ranked, ["case_key"], [F.col("r"), F.col("label"), F.col("id")], concept_limit).select("case_key", "place", "id", "key", "label"), "concepts")
    file_nodes = nodes.filter("layer = 1 AND kind = 'file'").select(F.col("id").alias("target_id"), F.col("key").alias("path"))
    starts = concepts.select("case_key", F.col("id").alias("source_id"))
    own = edges.join(starts, "source_id").join(file_nodes, "target_id").select("case_key", "path")
    around = edges.join(starts, "source_id").select("case_key", F.col("target_id").alias("id"), "relation").unionByName(edges.join(starts.withColumnRenamed("source_id", "target_id"), "target_id").select("case_key", F.col("source_id").alias("id"), "relation"))
    near = around.join(concept_nodes, "id").join(concepts.select("case_key", "id"), ["case_key", "id"], "left_anti").select("case_key", "id", "relation", "key", "label").distinct()
    closest = first(near.groupBy("case_key", "id").agg(F.min(F.struct("label", "relation")).alias("o")), ["case_key"], [F.col("o"), F.col("id")], HOP_CONCEPTS).select("case_key", F.col("id").alias("source_id"))
    reached = edges.join(closest, "source_id").join(file_nodes, "target_id").select("case_key", "source_id", "path").distinct()
    hop = first(reached, ["case_key", "source_id"], [F.col("path")], HOP_FILES).select("case_key", "path")
    tagged = files.select("case_key", F.col("key").alias("path"), F.lit(0).alias("priority")).unionByName(own.withColumn("priority", F.lit(1))).unionByName(hop.withColumn("priority", F.lit(2)))
    listed = first(tagged.groupBy("case_key", "path").agg(F.min("priority").alias("priority")), ["case_key"], [F.col("priority"), F.col("path")], file_limit)
    return {"concepts": concepts, "files": listed.select("case_key", "place", "path", "priority"), "neighbors": first(near, ["case_key"], [F.col("label"), F.col("relation"), F.col("id")], 10)}


def named_files(queries: DataFrame, files: DataFrame, limit: int = 12) -> DataFrame:
    """(case_key, place, path, score): the files of files(path, label) whose path or label holds a query's terms, best first.

    A term counts 10 if it is the whole path or label, else 4 and a tenth of its length up to ten in the path, else 3 in the label.
    """
    terms = stored(query_terms(queries).select("case_key", "term").distinct(), "terms")
    text = files.select(F.col("path").alias("id"), F.concat_ws("\x00", F.lower("path"), F.lower(F.coalesce("label", "path"))).alias("text"))
    sought = terms.select(F.col("term").alias("pattern"))
    held = stored(grams.containing(text, sought, grams.asked(text, sought)), "held").select(F.col("id").alias("path"), F.col("pattern").alias("term"))
    path, label, term = F.lower("path"), F.lower(F.coalesce("label", "path")), F.col("term")
    share = F.when((path == term) | (label == term), 10.0).when(F.contains(path, term), 4.0 + F.least(F.length(term), F.lit(10)) / 10).when(F.contains(label, term), 3.0).otherwise(0.0)
    score = held.join(files.select("path", "label"), "path").join(terms, "term").groupBy("case_key", "path").agg(F.round(F.sum(share), 6).alias("score")).filter("score > 0")
    return first(score, ["case_key"], [F.desc("score"), F.col("path")], limit)
