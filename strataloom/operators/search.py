"""Ranked search over nodes and tasks, and the context of a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S


HOP_CONCEPTS, HOP_FILES = 4, 4


def prioritized(sources: list[DataFrame], limit: int) -> DataFrame:
    """Paths of several sources; the first source that has a path gives its priority."""
    tagged = [s.select("path", F.lit(k).cast("long").alias("priority")) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).groupBy("path").agg(F.min("priority").alias("priority")).orderBy("priority", "path").limit(limit)


def search_nodes(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Best nodes(project_id, id, layer, kind, key, label, data, active, aliases, updated_at, and keywords if there are any) for a query, ties by label, then id.

    A node is a candidate if it holds a term, or if it is an active concept one of whose names the query holds.
    """
    terms, whole = S.search_terms(query), " ".join(query.lower().split())
    inactive = (F.col("layer") == 2) & (F.col("kind") == "concept") & ~F.coalesce("active", F.lit(True))
    if not terms:
        return nodes.filter(~inactive).orderBy(F.desc("layer"), F.desc("updated_at"), "id").limit(limit).withColumn("score", F.lit(0.0))
    more = [F.coalesce(c, F.array().cast("array<string>")) for c in ("aliases", "keywords") if c in nodes.columns]
    names = F.concat(F.array("label", "key"), *more)
    held = F.exists(names, lambda n: (F.length(F.trim(n)) >= 2) & F.contains(F.lit(whole), F.lower(F.trim(n))))
    hit = S.matches(terms, F.col("label"), F.col("key"), F.col("data")) | ((F.col("layer") == 2) & (F.col("kind") == "concept") & ~inactive & held)
    score = S.node_score(terms, whole, F.col("label"), F.col("key"), F.col("data"), F.col("layer"), inactive)
    return nodes.filter(hit).withColumn("score", score).orderBy(F.desc("score"), "label", "id").limit(limit)


def search_tasks(tasks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Best tasks(id, title, prompt, summary, created_at); a term counts 5 in the title and 1 elsewhere, older tasks first on ties."""
    terms = S.search_terms(query)
    if not terms:
        return tasks.orderBy(F.desc("created_at"), "id").limit(limit).withColumn("score", F.lit(0))
    title, rest = F.lower("title"), F.lower(F.concat_ws("\n", "title", "prompt", "summary"))
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(title, F.lit(t)), 5).when(F.contains(rest, F.lit(t)), 1).otherwise(0)
    return tasks.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "created_at", "id").limit(limit)


def context(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, task_concepts: DataFrame, query: str, concept_limit: int = 5, file_limit: int = 12, task_limit: int = 5) -> dict[str, DataFrame]:
    """concepts, files, neighbors, tasks and statistics of a query; edges(source_id, relation, target_id), task_concepts(task_id, concept_id)."""
    best = search_nodes(nodes, query, 40).select("id", "layer", "kind", "key", "label", "score")
    files = best.filter("layer = 1 AND kind = 'file'")
    direct = best.filter("layer = 2 AND kind = 'concept'").select("id", F.lit(0).alias("p"), "score")
    through = edges.join(files.select(F.col("id").alias("target_id"), "score"), "target_id").select(F.col("source_id").alias("id"), F.lit(1).alias("p"), "score")
    concept_nodes = nodes.filter("layer = 2 AND kind = 'concept'").select("id", "key", "label")
    ranked = direct.unionByName(through).groupBy("id").agg(F.min(F.struct("p", -F.col("score"))).alias("r")).join(concept_nodes, "id")
    concepts = ranked.orderBy("r", "label", "id").limit(concept_limit).select("id", "key", "label")
    file_nodes = nodes.filter("layer = 1 AND kind = 'file'").select(F.col("id").alias("target_id"), F.col("key").alias("path"))
    own = edges.join(concepts.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(file_nodes, "target_id").select("path")
    around = edges.join(concepts.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"), "relation").unionByName(edges.join(concepts.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"), "relation"))
    near = around.join(concept_nodes, "id").join(concepts.select("id"), "id", "left_anti").select("id", "relation", "key", "label").distinct()
    # One hop: the first files of the first neighbours of each concept list.
    closest = near.groupBy("id").agg(F.min(F.struct("label", "relation")).alias("o")).orderBy("o", "id").limit(HOP_CONCEPTS).select(F.col("id").alias("source_id"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("path"))
    hop = edges.join(closest, "source_id", "left_semi").join(file_nodes, "target_id").select("source_id", "path").distinct().withColumn("n", nth).filter(F.col("n") <= HOP_FILES).select("path")
    # Tasks found by their words come first, then those that touched the concepts, newest first.
    said = search_tasks(tasks, query, task_limit).withColumn("p", F.lit(0))
    touched = tasks.join(task_concepts.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").select(F.col("task_id").alias("id")), "id", "left_semi").withColumns({"score": F.lit(0), "p": F.lit(1)})
    both = said.unionByName(touched.select(said.columns))
    first = F.row_number().over(Window.partitionBy("id").orderBy("p"))
    history = both.withColumn("n", first).filter("n = 1").orderBy("p", F.desc("score"), F.desc("created_at"), "id").limit(task_limit).select(tasks.columns)
    totals = nodes.agg(F.count_if((F.col("layer") == 1) & (F.col("kind") == "file")).alias("files"), F.count_if((F.col("layer") == 2) & (F.col("kind") == "concept") & F.coalesce("active", F.lit(True))).alias("concepts"), F.count_if(F.col("kind") == "task").alias("tasks"))
    return {"concepts": concepts, "files": prioritized([files.select(F.col("key").alias("path")), own, hop], file_limit), "neighbors": near.orderBy("label", "relation", "id").limit(10), "tasks": history, "statistics": totals}


def render(found: dict[str, DataFrame]) -> str:
    """Short text of a context; every table in it is bounded."""
    out = []
    for name, column in (("concepts", "label"), ("files", "path"), ("neighbors", "label"), ("tasks", "title")):
        rows = found[name].collect()
        if rows:
            out += [f"{name}:", *[f"- {r[column]}" for r in rows]]
    return "\n".join(out)
