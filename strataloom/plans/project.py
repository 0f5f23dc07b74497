"""From files to the graph: physical layer, semantic layer, incremental scans, vault notes. Set-based over all projects at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import overlay, semantic
from ..runtime import stored
from ..sources import extract, listing, provider
from . import references, vault


@dataclass
class Graph:
    """nodes(project_id, layer, kind, key, id, label, data, confidence, source), edges(project_id, layer, source_id, relation, target_id, id, data, confidence, source)."""

    nodes: DataFrame
    edges: DataFrame
    facts: DataFrame
    file_edges: DataFrame
    references: references.State | None = None


def file_edges(facts: DataFrame) -> DataFrame:
    """(project_id, source, relation, target): resolved references and test targets."""
    return resolved(facts)[0]


def resolved(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between files, and (project_id, path, external): the packages that a file's unresolved imports name.

    Every way of resolving by path or by unique name is a list of keys: one join over all files of all projects.
    """
    found = references.state(facts)
    return found.edges(), found.packages()


def build(facts: DataFrame, before: DataFrame | None = None, state: references.State | None = None) -> Graph:
    """Physical and semantic layers of the facts; of the nodes ``before`` concepts that no file has any more stay inactive, and concepts keep their keywords.

    ``state`` are the references of all the facts, if a scan has them already; else they are resolved.
    """
    state = references.state(facts) if state is None else state
    edges, packages = state.edges(), state.packages()
    sid = lambda kind, key: S.stable_id("node_", F.col("project_id"), F.lit("1"), kind, key)
    file_data = F.to_json(F.struct("extractor", "digest", F.col("is_text"), F.parse_json("metadata").alias("metadata"), "roles", "size", "warnings", S.language(F.col("path")).alias("language"), "external"))
    files = facts.drop("external").join(packages, ["project_id", "path"], "left").select("project_id", F.lit(1).alias("layer"), F.lit("file").alias("kind"), F.col("path").alias("key"), F.coalesce(F.get_json_object("metadata", "$.title"), S.basename(F.col("path"))).alias("label"), file_data.alias("data"), F.lit(1.0).alias("confidence"), F.lit("filesystem").alias("source"))
    parts = facts.select("project_id", "path", F.explode("resources").alias("r"))
    resources = parts.select("project_id", F.lit(1).alias("layer"), "r.kind", F.concat("path", F.lit("#"), "r.key").alias("key"), "r.label", F.col("r.data").alias("data"), F.lit(1.0).alias("confidence"), F.lit("extractor").alias("source"))

    placed = semantic.file_concepts(facts.select("project_id", "path", "roles", F.get_json_object("metadata", "$.title").alias("title"), S.language(F.col("path")).alias("language")))
    role = S.role_relation(F.col("path"), F.col("roles"))
    placed = placed.withColumn("relation", F.coalesce(role, "relation")).withColumn("concept_key", F.col("concept_key"))
    keyed = placed.withColumn("ck", F.concat_ws("\x1e", "project_id", "concept_key"))
    titles = semantic.label_pick(keyed.select(F.col("ck").alias("concept_key"), "title", (F.col("relation") == "documented_by").alias("is_document")))
    stats = semantic.concept_stats(placed.select("project_id", "concept_key", "language"))
    fallback = placed.groupBy("project_id", "concept_key").agg(F.min("concept_label").alias("fallback"))
    named = stats.join(fallback, ["project_id", "concept_key"]).withColumn("ck", F.concat_ws("\x1e", "project_id", "concept_key")).join(titles.select(F.col("concept_key").alias("ck"), F.col("label").alias("picked")), "ck", "left")
    by_role = semantic.role_counts(keyed.select(F.col("ck").alias("concept_key"), "roles"))
    most = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["role"] < b["role"], -1).otherwise(1)
    roles = by_role.groupBy(F.col("concept_key").alias("ck")).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("role", "n")), most), lambda x: F.struct(x["role"], x["n"]))).alias("roles"))
    was = None if before is None else before.filter("layer = 2 AND kind = 'concept'")
    held = None if was is None else was.select("project_id", F.col("key").alias("concept_key"), F.from_json(F.get_json_object("data", "$.keywords"), "array<string>").alias("keywords"))
    words = semantic.concept_keywords(placed.select("project_id", "concept_key", "path").join(facts.select("project_id", "path", "metadata"), ["project_id", "path"]), held)
    named = named.join(roles, "ck", "left").join(words, ["project_id", "concept_key"], "left")
    concepts = named.select("project_id", F.lit(2).alias("layer"), F.lit("concept").alias("kind"), F.col("concept_key").alias("key"), F.coalesce("picked", "fallback").alias("label"), F.to_json(F.struct(F.lit(True).alias("active"), "file_count", "languages", "roles", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))).alias("data"), F.when(F.col("picked").isNotNull(), 0.78).otherwise(0.72).alias("confidence"), F.lit("semantic-heuristic").alias("source"))
    if was is not None:
        # A concept that lost its files is not deleted: tasks and corrections may name it.
        gone = was.join(concepts.select("project_id", "key"), ["project_id", "key"], "left_anti")
        idle = F.regexp_replace(F.regexp_replace("data", '"active":"?true"?', '"active":false'), '"file_count":"?[0-9]+"?', '"file_count":0')
        concepts = concepts.unionByName(gone.select("project_id", "layer", "kind", "key", "label", idle.alias("data"), "confidence", "source"))
    projects = facts.select("project_id").distinct().select("project_id", F.lit(2).alias("layer"), F.lit("project").alias("kind"), F.col("project_id").alias("key"), F.col("project_id").alias("label"), F.lit("{}").alias("data"), F.lit(1.0).alias("confidence"), F.lit("project-registry").alias("source"))
    nodes = files.unionByName(resources).unionByName(concepts).unionByName(projects).withColumn("id", S.stable_id("node_", F.col("project_id"), F.col("layer"), F.col("kind"), F.col("key")))

    l2 = lambda kind, key: S.stable_id("node_", F.col("project_id"), F.lit("2"), F.lit(kind), key)
    def edge(df: DataFrame, layer: int, source, relation, target, confidence, origin: str, data=None) -> DataFrame:
        return df.select("project_id", F.lit(layer).alias("layer"), source.alias("source_id"), relation.alias("relation"), target.alias("target_id"), F.coalesce(data if data is not None else F.lit("{}")).alias("data"), confidence.alias("confidence"), F.lit(origin).alias("source"))

    one = F.lit(1.0)
    l1 = edge(edges, 1, sid(F.lit("file"), F.col("source")), F.col("relation"), sid(F.lit("file"), F.col("target")), one, "extractor")
    contains = edge(parts, 1, sid(F.lit("file"), F.col("path")), F.lit("contains"), sid(F.col("r.kind"), F.concat("path", F.lit("#"), "r.key")), one, "extractor")
    kinds = parts.select("project_id", "path", F.col("r.key").alias("k"), F.col("r.kind").alias("kind")).distinct()
    inner = facts.select("project_id", "path", F.explode("relations").alias("x")).select("project_id", "path", F.col("x.source").alias("s"), F.col("x.relation").alias("relation"), F.col("x.target").alias("t"))
    ends = inner.join(kinds.select("project_id", "path", F.col("k").alias("t"), F.col("kind").alias("tk")), ["project_id", "path", "t"]).join(kinds.select("project_id", "path", F.col("k").alias("s"), F.col("kind").alias("sk")), ["project_id", "path", "s"], "left").filter("(s = '' OR sk IS NOT NULL) AND s <> t")
    related = edge(ends, 1, F.when(F.col("s") == "", sid(F.lit("file"), F.col("path"))).otherwise(sid(F.col("sk"), F.concat("path", F.lit("#"), "s"))), F.col("relation"), sid(F.col("tk"), F.concat("path", F.lit("#"), "t")), one, "extractor")
    owns = edge(placed, 2, l2("concept", F.col("concept_key")), F.col("relation"), sid(F.lit("file"), F.col("path")), F.lit(0.75), "semantic-heuristic")
    holds = edge(stats, 2, l2("project", F.col("project_id")), F.lit("contains"), l2("concept", F.col("concept_key")), one, "project-registry")
    full = lambda c: F.concat_ws("\x1e", "project_id", c)
    lifted = semantic.concept_edges(edges.select(full("source").alias("source"), "relation", full("target").alias("target")), keyed.select(full("path").alias("path"), F.col("ck").alias("concept_key")))
    halves = lambda c, k: F.split(c, "\x1e").getItem(k)
    lifted = lifted.select(halves("source_concept", 0).alias("project_id"), halves("source_concept", 1).alias("a"), halves("target_concept", 1).alias("b"), "relation", "confidence", F.to_json(F.struct("n", "evidence")).alias("evidence"))
    depends = edge(lifted, 2, l2("concept", F.col("a")), F.col("relation"), l2("concept", F.col("b")), F.col("confidence"), "semantic-heuristic", F.col("evidence"))
    every = l1.unionByName(contains).unionByName(related).unionByName(owns).unionByName(holds).unionByName(depends).distinct()
    return Graph(nodes, every.withColumn("id", S.stable_id("edge_", *[F.col(c) for c in ("project_id", "layer", "source_id", "relation", "target_id")])), facts, edges, state)


def apply_corrections(graph: Graph, log: DataFrame) -> Graph:
    """The graph with human corrections(project_id, seq, action, subject_key, relation, object_key, value) of all its projects.

    The automatic layers are built anew at every scan and corrections apply to them again, so a scan never loses one. Keys carry
    their project while corrections apply, so projects can't touch each other. Corrections with an error are left out.
    """
    graph = Graph(stored(graph.nodes, "nodes"), stored(graph.edges, "edges"), graph.facts, graph.file_edges, graph.references)
    own = lambda c: F.concat_ws("\x1e", "project_id", c)
    part = lambda c, k: F.split(c, "\x1e").getItem(k)
    ok = overlay.checked(log).filter("error IS NULL")
    file_end = F.col("action").isin(overlay.FILE_ACTIONS)
    keyed = ok.withColumn("object_key", F.when((F.col("action") == "merge_concept") | F.col("action").isin(overlay.EDGE_ACTIONS) | file_end, own("object_key")).otherwise(F.col("object_key"))).withColumn("subject_key", own("subject_key"))
    standing = stored(overlay.last_per_slot(keyed), "corrections")
    n = graph.nodes.filter("layer = 2 AND kind = 'concept'")
    data = lambda x: F.get_json_object("data", x)
    concepts = n.select(own("key").alias("key"), "label", F.coalesce(data("$.active").cast("boolean"), F.lit(True)).alias("active"), F.coalesce(F.from_json(data("$.aliases"), "array<string>"), F.array().cast("array<string>")).alias("aliases"), "confidence", "source")
    names = graph.nodes.filter("kind IN ('concept', 'file', 'task', 'project') AND layer IN (1, 2, 3)").select("id", "kind", own("key").alias("k"))
    both = graph.edges.filter("layer IN (2, 3)").join(names.select(F.col("id").alias("source_id"), F.col("k").alias("s"), F.col("kind").alias("sk")), "source_id").join(names.select(F.col("id").alias("target_id"), F.col("k").alias("t"), F.col("kind").alias("tk")), "target_id")
    mine = both.filter("(layer = 2 AND sk = 'concept') OR (layer = 3 AND relation = 'affects')")
    files = graph.nodes.filter("layer = 1 AND kind = 'file'").select(own("key").alias("path"))
    after, changed = overlay.apply_all(concepts, mine.select("layer", F.col("s").alias("source"), "relation", F.col("t").alias("target"), F.col("tk").alias("target_kind"), "data"), files, standing)
    after, changed = stored(after, "concepts"), stored(changed, "semantic")

    nid = lambda layer, kind, key: S.stable_id("node_", F.col("project_id"), layer, kind, part(key, 1))
    concept_data = F.to_json(F.struct("active", "aliases", "human_reviewed", "review_decision", part("merged_into", 1).alias("merged_into")))
    old = n.select(own("key").alias("key"), F.col("data").alias("old"))

    def over(old: Column, new: Column) -> Column:
        """JSON of an object with the values that ``new`` has in place of its own."""
        fields = F.coalesce(F.from_json(old, "map<string,string>"), F.create_map().cast("map<string,string>"))
        more = F.map_filter(new, lambda _, v: v.isNotNull())
        return F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more))

    merged_data = over(F.col("old"), F.from_json(concept_data, "map<string,string>"))
    fresh = after.withColumn("project_id", part("key", 0)).join(old, "key", "left").select("project_id", F.lit(2).alias("layer"), F.lit("concept").alias("kind"), part("key", 1).alias("key"), "label", F.when(F.col("human_reviewed"), merged_data).otherwise(F.col("old")).alias("data"), "confidence", "source", nid(F.lit("2"), F.lit("concept"), F.col("key")).alias("id"))
    kept_nodes = graph.nodes.filter("NOT (layer = 2 AND kind = 'concept')")
    target_layer = F.when(F.col("target_kind") == "file", "1").otherwise("2")
    e = changed.withColumn("project_id", part("source", 0))
    source_id = nid(F.col("layer").cast("string"), F.when(F.col("layer") == 3, "task").otherwise("concept"), F.col("source"))
    info = over(F.col("data"), F.create_map(F.lit("merged_from"), part("merged_from", 1), F.lit("review_decision"), F.col("review_decision")))
    e = e.select("project_id", "layer", source_id.alias("source_id"), "relation", nid(target_layer, F.col("target_kind"), F.col("target")).alias("target_id"), F.when(F.col("human"), info).otherwise(F.col("data")).alias("data"), F.col("human"))
    e = e.withColumn("id", S.stable_id("edge_", *[F.col(c) for c in ("project_id", "layer", "source_id", "relation", "target_id")]))
    before = graph.edges.select("id", F.col("confidence").alias("_c"), F.col("source").alias("_s"))
    e = e.join(before, "id", "left").select("project_id", "layer", "source_id", "relation", "target_id", "data", F.when(F.col("human"), 1.0).otherwise(F.col("_c")).alias("confidence"), F.when(F.col("human"), "human-overlay").otherwise(F.col("_s")).alias("source"), "id")
    edges = graph.edges.join(mine.select("id"), "id", "left_anti").select(e.columns).unionByName(e)
    return Graph(kept_nodes.unionByName(fresh.select(kept_nodes.columns)), edges, graph.facts, graph.file_edges, graph.references)


def scan(files: DataFrame, previous: DataFrame | None = None, plugins: list[extract.Plugin] = (), corrections: DataFrame | None = None, ask: Callable[[Graph], Graph] | None = None, before: DataFrame | None = None, state: references.State | None = None) -> tuple[Graph, DataFrame]:
    """(graph, changes) of files(project_id, path, mtime_ns, size, content); ``previous`` are the facts of the last scan with mtime_ns.

    ``before`` are the nodes of the last scan's graph: concepts without files stay in the graph, inactive, and keywords are kept.
    ``ask`` adds what an external provider says (``ask_provider``); ``corrections`` are applied to the whole, at every scan.

    Only new and changed files, and files of another extractor signature, are read again. Raw references are kept with the
    facts, so a new file also satisfies references that did not resolve before. With ``state``, the stored references of the last
    scan's graph, only files whose references have another answer now are resolved again; without it all references join anew.
    """

    def corrected(g: Graph) -> Graph:
        g = g if ask is None else ask(g)
        return g if corrections is None else apply_corrections(g, corrections)

    sign = extract.signature(plugins)
    if previous is None:
        facts = extract.extract_files(files, plugins).join(files.select("project_id", "path", "mtime_ns"), ["project_id", "path"])
        return corrected(build(facts, before)), files.select("project_id", "path", F.lit("new").alias("change"))
    now = files.select("project_id", "path", "mtime_ns", "size", F.lit(sign).alias("extractor"))
    changes = listing.change_set(now, previous, ["project_id", "path"], ["mtime_ns", "size", "extractor"])
    fresh = files.join(changes.filter("change <> 'deleted'").select("project_id", "path"), ["project_id", "path"], "left_semi")
    kept = previous.join(changes.select("project_id", "path"), ["project_id", "path"], "left_anti")
    read = extract.extract_files(fresh, plugins).join(fresh.select("project_id", "path", "mtime_ns"), ["project_id", "path"])
    if state is not None:
        changes, read = stored(changes, "changes"), stored(read, "facts")
        state = references.update(state, read, changes)[0].stored()
    return corrected(build(kept.unionByName(read), before, state)), changes


def merge_provider(graph: Graph, concepts: DataFrame, relations: DataFrame) -> Graph:
    """Add an external provider's concepts(project_id, key, label, files, confidence) and relations(project_id, source, relation, target, confidence).

    Confidences are clamped, unknown files and end points are dropped. Of items that repeat a concept or an edge the last by
    ``place`` counts; ``place``, ``data`` of concepts and ``evidence`` of relations (both JSON) may be missing.
    """
    with_default = lambda df, name, value: df if name in df.columns else df.withColumn(name, F.lit(value))
    clamped = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    c = with_default(with_default(concepts, "place", 0), "data", "{}").withColumn("confidence", clamped)
    r = with_default(with_default(relations, "place", 0), "evidence", "[]").withColumn("confidence", clamped)
    name = F.lit("external-semantic-provider").alias("source")
    node = lambda kind, layer, key: S.stable_id("node_", F.col("project_id"), F.lit(layer), F.lit(kind), key)

    def last(df: DataFrame) -> DataFrame:
        rest = [x for x in df.columns if x not in ("id", "place")]
        return df.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("place", *rest)).alias("v")).select("id", "v.*")

    data = F.concat(F.lit('{"active":true,"provider_data":'), "data", F.lit("}"))
    nodes = last(c.select("place", "project_id", F.lit(2).alias("layer"), F.lit("concept").alias("kind"), "key", "label", data.alias("data"), "confidence", name, node("concept", "2", F.col("key")).alias("id")))
    merged = graph.nodes.join(nodes.select("id"), "id", "left_anti").unionByName(nodes)
    known = graph.nodes.select(F.col("id").alias("target_id"))
    flat = c.select("project_id", "place", "key", "confidence", F.explode("files").alias("path"))
    mapped = flat.select("project_id", "place", node("concept", "2", F.col("key")).alias("source_id"), F.lit("implemented_by").alias("relation"), node("file", "1", F.col("path")).alias("target_id"), "confidence", F.to_json(F.struct("path")).alias("data")).join(known, "target_id", "left_semi")
    ends = merged.select("id")
    evidence = F.concat(F.lit('{"evidence":'), "evidence", F.lit("}"))
    linked = r.select("project_id", "place", node("concept", "2", F.col("source")).alias("source_id"), "relation", node("concept", "2", F.col("target")).alias("target_id"), "confidence", evidence.alias("data"))
    linked = linked.join(ends.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ends.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    extra = mapped.unionByName(linked).withColumn("layer", F.lit(2)).withColumn("source", name)
    extra = last(extra.withColumn("id", S.stable_id("edge_", *[F.col(x) for x in ("project_id", "layer", "source_id", "relation", "target_id")])))
    return Graph(merged, graph.edges.join(extra.select("id"), "id", "left_anti").unionByName(extra), graph.facts, graph.file_edges, graph.references)


def ask_provider(graph: Graph, projects: DataFrame, command: str, timeout: float = provider.TIMEOUT) -> Graph:
    """The graph with what the program ``command`` says about projects(project_id, name, root, kind); each project is asked once."""
    answer = stored(provider.answers(graph.nodes, graph.edges, projects, command, timeout), "provider")
    return merge_provider(graph, *provider.parsed(answer))


def vault_notes(graph: Graph, project: str, root: str, tasks: DataFrame, affects: DataFrame) -> DataFrame:
    """The vault (``vault.notes``) of one project of a graph; tasks(task, title, status, created_at, summary), affects(task, key)."""
    label = graph.nodes.filter(F.col("project_id") == project).select("id", "layer", "kind", "key", "label")
    concepts = label.filter("layer = 2 AND kind = 'concept'")
    own = graph.edges.filter((F.col("project_id") == project) & (F.col("layer") == 2)).select("source_id", "relation", "target_id").join(concepts.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id")
    files = own.join(label.filter("layer = 1 AND kind = 'file'").select(F.col("id").alias("target_id"), F.col("key").alias("path")), "target_id").select(F.col("source").alias("key"), "path").distinct()
    relations = own.join(concepts.select(F.col("id").alias("target_id"), F.col("key").alias("target")), "target_id").select("source", "relation", "target").distinct()
    return vault.notes(project, root, concepts.select("key", "label"), files, relations, tasks, affects)
