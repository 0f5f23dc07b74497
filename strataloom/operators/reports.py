"""Reports on a graph and on evaluation runs: statistics, impact of a file, history, lists, candidates by mode, suites.

nodes(id, project_id, layer, kind, key, label, active), edges(project_id, layer, source_id, relation, target_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..runtime import stored
from . import evaluate, graph, routing

OUTSIDE = ("contains", "merged_into")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: files, active concepts, tasks, and edges of the first and second layer, each table read once."""
    kind = lambda layer, k: (F.col("layer") == layer) & (F.col("kind") == k)
    n = nodes.groupBy("project_id").agg(F.count_if(kind(1, "file")).alias("files"), F.count_if(kind(2, "concept") & F.coalesce("active", F.lit(True))).alias("concepts"), F.count_if(kind(3, "task")).alias("tasks"), F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("project_id").agg(F.count_if(F.col("layer") == 1).alias("physical_edges"), F.count_if(F.col("layer") == 2).alias("semantic_edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(e, "project_id", "left").select("project_id", "files", "concepts", "tasks", "nodes", zero("physical_edges"), zero("semantic_edges"))


def file_impact(nodes: DataFrame, edges: DataFrame, tasks: DataFrame, project: str, selector: str, task_limit: int = 20) -> DataFrame:
    """What a change of one file may touch: (section, relation, key, label), or one row of section ``error``.

    The selector is a path, else a part of exactly one path or label. Sections are file, outgoing, incoming, concept, neighbour (of
    these concepts) and task (the newest ones that touched it). Nothing is collected but the ten matches that an error shows.
    """
    own_nodes, own_edges = nodes.filter(F.col("project_id") == project), edges.filter(F.col("project_id") == project)
    wanted = selector.replace("\\", "/").strip()
    files = own_nodes.filter("layer = 1 AND kind = 'file'").select("id", "key", "label")
    near = files.filter(F.contains(F.lower("key"), F.lit(wanted.lower())) | F.contains(F.lower("label"), F.lit(wanted.lower())))
    found = near.select("id", "key", (F.col("key") == wanted).alias("exact")).orderBy(F.desc("exact"), F.length("key"), "key").limit(10).collect()
    spark = nodes.sparkSession
    if not found or (len(found) > 1 and not found[0].exact):
        say = "no file matches" if not found else "several files match: " + ", ".join(r.key for r in found)
        return spark.createDataFrame([("error", "", wanted, say)], "section string, relation string, key string, label string")
    me = found[0].id
    row = lambda df, section, relation: df.select(F.lit(section).alias("section"), relation.alias("relation"), "key", "label")
    ends = own_nodes.select("id", "layer", "kind", "key", "label")
    physical = own_edges.filter("layer = 1")
    out = row(physical.filter(F.col("source_id") == me).join(ends.withColumnRenamed("id", "target_id").drop("layer"), "target_id"), "outgoing", F.col("relation"))
    back = row(physical.filter(F.col("target_id") == me).join(ends.withColumnRenamed("id", "source_id").drop("layer"), "source_id"), "incoming", F.col("relation"))
    all_concepts = ends.filter("layer = 2 AND kind = 'concept'").select("id", "key", "label")
    semantic = own_edges.filter("layer = 2")
    concepts = all_concepts.join(semantic.filter(F.col("target_id") == me).select(F.col("source_id").alias("id")), "id", "left_semi")
    ids = concepts.select("id")
    both = semantic.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"), "relation").unionByName(semantic.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(F.col("source_id").alias("id"), "relation"))
    around = both.filter(~F.col("relation").isin(*OUTSIDE)).distinct().join(all_concepts, "id")
    touched = own_edges.filter((F.col("layer") == 3) & (F.col("target_id") == me)).select(F.col("source_id").alias("id"), "relation").join(own_nodes.filter("kind = 'task'").select("id", F.col("key").alias("task")), "id")
    newest = touched.join(tasks.select("task", "title", "created_at"), "task").orderBy(F.desc("created_at"), "task", "relation").limit(task_limit).select("relation", F.col("task").alias("key"), F.col("title").alias("label"))
    this = files.filter(F.col("id") == me)
    parts = [row(this, "file", F.lit("")), out, back, row(concepts, "concept", F.lit("")), row(around, "neighbour", F.col("relation")), row(newest, "task", F.col("relation"))]
    return reduce(DataFrame.unionByName, parts)


def listed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """A page of a list of tasks, projects, corrections or runs in a total order."""
    return rows.orderBy(*order).limit(limit)


def history(tasks: DataFrame, limit: int = 20) -> DataFrame:
    """The newest tasks(task, created_at, …); ties by id."""
    return listed(tasks, [F.desc("created_at"), F.col("task")], limit)


def one_task(tasks: DataFrame, task: str) -> DataFrame:
    """The row of a task; a LookupError if there is none."""
    found = tasks.filter(F.col("task") == task)
    if found.isEmpty():
        raise LookupError(f"no task {task}")
    return found


def inventory(nodes: DataFrame) -> DataFrame:
    """(project_id, path, size, language) of the files of a graph; unknown or negative sizes count as 0."""
    size = F.coalesce(F.get_json_object("data", "$.size").cast("long"), F.lit(0))
    return nodes.filter("layer = 1 AND kind = 'file'").select("project_id", F.col("key").alias("path"), F.greatest(size, F.lit(0)).alias("size"), S.language(F.col("key")).alias("language"))


def candidates(cases: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """(case_key, mode, path): the files that each of cases(case_key, query) gets under three modes; nodes and edges as ``routing.contexts`` takes them.

    A full scan reads every file, file-name search the ``limit`` best names for the query, the routed mode the first ``limit`` files of
    the query's context. All cases go through one plan.
    """
    files = nodes.filter("layer = 1 AND kind = 'file'").select(F.col("key").alias("path"), "label")
    mode = lambda df, name: df.select("case_key", F.lit(name).alias("mode"), "path")
    cases = stored(cases.select("case_key", "query"), "cases")
    whole = F.broadcast(cases.select("case_key")).crossJoin(files.select("path"))  # every file for every case is what the mode means
    # The two other modes have a few files a case; they are written, so that what reads the candidates twice ranks them once.
    routed = stored(routing.contexts(cases, nodes, edges, file_limit=limit)["files"].select("case_key", "path"), "routed")
    named = stored(routing.named_files(cases, files, limit).select("case_key", "path"), "named")
    return mode(whole, "full-scan").unionByName(mode(named, "filename-search")).unionByName(mode(routed, "routed"))


def run_suite(cases: DataFrame, found: DataFrame, files: DataFrame) -> DataFrame:
    """A run for each case and mode: cases(case_key, expected array), found(case_key, mode, path), files(path, size).

    Hits are counted by joins, so no list of candidates is held in one row. Tokens are bytes by four, rounded up.
    """
    want = cases.select("case_key", F.explode(F.array_distinct("expected")).alias("path"))
    asked = want.groupBy("case_key").agg(F.count(F.lit(1)).alias("expected"))
    hit = found.distinct().join(want.withColumn("hit", F.lit(1)), ["case_key", "path"], "left").join(files.select("path", "size"), "path", "left")
    got = stored(hit.groupBy("case_key", "mode").agg(F.count(F.lit(1)).alias("candidates"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes")), "runs")
    total = files.agg(F.count(F.lit(1)).alias("all_files"), F.sum("size").alias("all_bytes"))
    modes = got.select("mode").distinct()
    rows = cases.select("case_key").crossJoin(modes).join(got, ["case_key", "mode"], "left").join(asked, "case_key", "left").crossJoin(total)  # few cases, three modes, one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, h, m = zero("candidates"), zero("hits"), zero("expected")
    return rows.select("case_key", "mode", n.alias("candidates"), h.alias("hits"), (m - h).alias("missing"), F.when(n > 0, h / n).otherwise(0.0).alias("precision"), F.when(m > 0, h / m).otherwise(1.0).alias("recall"), F.ceil(zero("bytes") / 4).alias("tokens"), F.when(F.col("all_files") > 0, 1 - n / F.col("all_files")).otherwise(0.0).alias("candidate_reduction"))


def observed(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Metrics of real tasks: events(task, kind, path), expected(task, path). Shares are null where nothing is expected or read."""
    touched = events.filter("path IS NOT NULL").groupBy("task", "path").agg(F.max(F.when(F.col("kind") == "read", 1).otherwise(0)).alias("was_read"))
    want = expected.select("task", "path").distinct().withColumn("want", F.lit(1))
    both = touched.withColumn("seen", F.lit(1)).join(want, ["task", "path"], "full")
    n = lambda c: F.count(F.when(c, 1))
    read, wanted, seen = F.coalesce("was_read", F.lit(0)) == 1, F.col("want").isNotNull(), F.col("seen").isNotNull()
    got = both.groupBy("task").agg(n(seen).alias("observed_files"), n(read).alias("read_files"), n(wanted).alias("expected"), n(wanted & seen).alias("hits"), n(read & ~wanted).alias("loose"))
    some = F.col("expected") > 0
    return got.select("task", "observed_files", "read_files", "expected", F.when(some, F.col("hits") / F.col("expected")).alias("recall"), F.when(some, F.col("loose")).alias("irrelevant_reads"), F.when(some & (F.col("read_files") > 0), F.col("loose") / F.col("read_files")).alias("irrelevant_ratio"))


PAIRS = [("retrieval", "full-scan", "routed"), ("retrieval", "filename-search", "routed"), ("observed", "baseline", "routed")]


def comparisons(runs: DataFrame) -> DataFrame:
    """The three fixed comparisons over the latest runs(case_key, run_kind, mode, tokens, recall, success, created_at, seq); pairs without a case are left out."""
    latest = evaluate.latest_runs(runs)
    out = []
    for kind, before, after in PAIRS:
        one = evaluate.compare(latest.filter(F.col("run_kind") == kind), before, after, kind == "observed")
        out.append(one.withColumns({"run_kind": F.lit(kind), "baseline": F.lit(before), "routed": F.lit(after)}))
    return reduce(DataFrame.unionByName, out).filter("pairs > 0")


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ``gone(id)`` and without every edge that names one: two anti-joins for the two ends."""
    left = edges.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(edges.columns)


def remove_file(nodes: DataFrame, edges: DataFrame, project: str, path: str) -> tuple[DataFrame, DataFrame]:
    """A file and its parts, whose keys begin with its path and a number sign, and all their edges go."""
    mine = (F.col("project_id") == project) & (F.col("layer") == 1) & ((F.col("key") == path) | F.startswith(F.col("key"), F.lit(path + "#")))
    return remove_nodes(nodes, edges, nodes.filter(mine).select("id"))


def reset_layer(nodes: DataFrame, edges: DataFrame, layer: int, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without a layer, of one project or of all, and without placeholder files and concepts that nothing names any more."""
    own = F.col("layer") == layer if project is None else (F.col("layer") == layer) & (F.col("project_id") == project)
    kept_nodes, kept_edges = remove_nodes(nodes, edges.filter(~own), nodes.filter(own).select("id"))
    loose = graph.unlinked(kept_nodes.filter(F.coalesce(F.get_json_object("data", "$.placeholder"), F.get_json_object("data", "$.replay_placeholder")) == "true"), kept_edges)
    return kept_nodes.join(loose.select("id"), "id", "left_anti"), kept_edges
