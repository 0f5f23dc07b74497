"""Graph hops, reference resolution, the semantic layer and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S
from ..operators import graph, overlay, resolve, semantic
from ..runtime import importable, stored, table
from ..sources import listing
from . import references
from .registry import query
from .standins import FILES_SQL, files


def _part_edges(spark, sf):
    """Nodes and edges of orders, parts and suppliers: an order points to its parts and suppliers."""
    li = table(spark, sf, "lineitem")
    o = F.concat(F.lit("o"), "l_orderkey")
    edges = li.select(o.alias("source_id"), F.lit("has_part").alias("relation"), F.concat(F.lit("p"), "l_partkey").alias("target_id")).unionByName(li.select(o.alias("source_id"), F.lit("has_supplier").alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("target_id")))
    part, supp = table(spark, sf, "part"), table(spark, sf, "supplier")
    nodes = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit(1).alias("layer"), F.col("p_brand").alias("key"), F.col("p_name").alias("label")).unionByName(supp.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit(2).alias("layer"), F.col("s_name").alias("key"), F.col("s_name").alias("label")))
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit(3).alias("layer"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("label"))
    return nodes.unionByName(orders), edges


_EDGES = "SELECT 'o' || l_orderkey AS source_id, 'has_part' AS relation, 'p' || l_partkey AS target_id FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 'has_supplier', 's' || l_suppkey FROM lineitem"
_NODES = "SELECT 'p' || p_partkey AS id, 1 AS layer, p_brand AS key, p_name AS label FROM part UNION ALL SELECT 's' || s_suppkey, 2, s_name, s_name FROM supplier UNION ALL SELECT 'o' || o_orderkey, 3, o_orderstatus, o_orderpriority FROM orders"


@query(f"""
    WITH e AS ({_EDGES}), n AS ({_NODES}), h AS (SELECT source_id AS node, 'out' AS direction, relation, target_id AS neighbor FROM e UNION ALL SELECT target_id, 'in', relation, source_id FROM e)
    SELECT node, direction, relation, neighbor, key, label FROM h JOIN n ON neighbor = id WHERE node IN ('p1', 'p2', 's1', 'o1', 'o2', 'o3')
""")
def neighbors_in_out(spark, sf):
    nodes, edges = _part_edges(spark, sf)
    return graph.neighbors(edges, nodes, F.col("node").isin("p1", "p2", "s1", "o1", "o2", "o3"))


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT source_id, count(*) AS n, count(DISTINCT key) AS keys FROM e JOIN n ON target_id = id WHERE layer = 1 GROUP BY source_id")
def concept_files(spark, sf):
    nodes, edges = _part_edges(spark, sf)
    return graph.targets(edges, nodes, layer=1).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"))


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT id, key, label FROM n WHERE id IN (SELECT source_id FROM e WHERE target_id IN ('p1', 'p7', 's3'))")
def file_concepts_distinct(spark, sf):
    nodes, edges = _part_edges(spark, sf)
    return graph.sources_of(nodes, edges, F.col("target_id").isin("p1", "p7", "s3")).select("id", "key", "label")


@query("""
    SELECT c_custkey, o_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13') AND o_orderstatus = 'F'
""")
def three_way_affects(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").filter("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    out = li.join(parts, "l_partkey", "left_semi").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return out.join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "l_partkey")


@query("""
    WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    SELECT DISTINCT l_orderkey AS task, s_nationkey AS concept FROM t JOIN c USING (l_partkey)
""")
def two_hop_snapshot(spark, sf):
    from ..operators.tasklog import snapshot

    li = table(spark, sf, "lineitem")
    parts = li.join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("path"), F.col("s_nationkey").alias("concept"))
    return snapshot(li.select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("path")), parts)


def _tests(spark, sf):
    p = table(spark, sf, "part")
    f = files(spark, sf)
    pairs = resolve.test_targets(f.filter(F.col("path").startswith("src/") | F.col("path").startswith("tests/")).select("path"))
    return p, f, pairs


@query(f"""
    WITH f AS ({FILES_SQL}), t AS (SELECT path AS source, substring(regexp_extract(path, '[^/]*$'), 6) AS name FROM f WHERE path LIKE 'tests/test\\_%' ESCAPE '\\'),
    e AS (SELECT t.source, 'tests' AS relation, f.path AS target FROM t JOIN f ON regexp_extract(f.path, '[^/]*$') = t.name AND f.path LIKE 'src/%'),
    s AS (SELECT min(path) AS path FROM (SELECT path FROM f WHERE contains(lower(path), 'src/brand_13/')) HAVING count(*) >= 1)
    SELECT 'in' AS direction, relation, source AS path FROM e WHERE target = (SELECT min(target) FROM e) UNION ALL SELECT 'out', relation, target FROM e WHERE source = (SELECT min(target) FROM e)
""")
def impact_exact_or_unique(spark, sf):
    _, f, pairs = _tests(spark, sf)
    edges = pairs.withColumn("relation", F.lit("tests"))
    selector = pairs.agg(F.min("target")).first()[0]  # one path
    return graph.impact(f.select("path"), edges, selector)


@query(f"""
    WITH f AS ({FILES_SQL}), t AS (SELECT path AS source, substring(regexp_extract(path, '[^/]*$'), 6) AS name FROM f WHERE starts_with(path, 'tests/test_')),
    j AS (SELECT source, path AS target, row_number() OVER (PARTITION BY source ORDER BY len(list_intersect(list_distinct(string_split(source, '/')), list_distinct(string_split(path, '/')))) DESC, len(string_split(path, '/')), path) AS p FROM t JOIN f ON regexp_extract(f.path, '[^/]*$') = name)
    SELECT source, target FROM j WHERE p = 1
""")
def test_target_rank(spark, sf):
    return _tests(spark, sf)[2]


@query(f"""
    WITH f AS ({FILES_SQL}), r AS (SELECT path AS source, '../../' || regexp_replace(path, '\\.[^.]+$', '') || '#top' AS reference FROM f WHERE starts_with(path, 'src/')
        UNION ALL SELECT path, 'https://example.com/' || path FROM f WHERE starts_with(path, 'docs/') UNION ALL SELECT path, '/' || path || '?raw=1' FROM f WHERE starts_with(path, 'config/')
        UNION ALL SELECT path, '../../../' || path FROM f WHERE starts_with(path, 'config/'))
    SELECT source, reference, CASE WHEN starts_with(source, 'src/') OR (starts_with(source, 'config/') AND starts_with(reference, '/')) THEN source END AS target FROM r
""")
def first_match_resolution(spark, sf):
    f = files(spark, sf).select("path")
    p = F.col("path")
    refs = f.filter(p.startswith("src/")).select(p.alias("source"), F.concat(F.lit("../../"), F.regexp_replace(p, r"\.[^.]+$", ""), F.lit("#top")).alias("reference"))
    refs = refs.unionByName(f.filter(p.startswith("docs/")).select(p.alias("source"), F.concat(F.lit("https://example.com/"), p).alias("reference")))
    config = f.filter(p.startswith("config/"))
    refs = refs.unionByName(config.select(p.alias("source"), F.concat(F.lit("/"), p, F.lit("?raw=1")).alias("reference"))).unionByName(config.select(p.alias("source"), F.concat(F.lit("../../../"), p).alias("reference")))
    return resolve.first_match(refs, f, [".js", ".py"])


@query(f"""
    WITH f AS ({FILES_SQL}), k AS (SELECT lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', '')) AS key, path FROM f), u AS (SELECT key, min(path) AS target FROM k GROUP BY key HAVING count(*) = 1),
    n AS (SELECT doc_id AS source, 'pkg.' || lang || '_' || doc_id AS name FROM documents UNION ALL SELECT c_custkey, CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT c_custkey, 'a.b.missing' FROM customer)
    SELECT source, name, target FROM n LEFT JOIN u ON u.key = lower(regexp_replace(name, '^.*\\.', ''))
""")
def unique_stem_resolution(spark, sf):
    d, c = table(spark, sf, "documents"), table(spark, sf, "customer")
    names = d.select(F.col("doc_id").alias("source"), F.concat(F.lit("pkg."), "lang", F.lit("_"), "doc_id").alias("name")).unionByName(c.select(F.col("c_custkey").alias("source"), F.col("c_custkey").cast("string").alias("name"))).unionByName(c.select(F.col("c_custkey").alias("source"), F.lit("a.b.missing").alias("name")))
    return resolve.by_unique_stem(names, files(spark, sf)).select("source", "name", "target")


@query(f"WITH f AS ({FILES_SQL}), k AS (SELECT lower(regexp_replace(regexp_extract(path, '[^/]*$'), '_[0-9]+(\\.[^.]+)$', '\\1')) AS key, path FROM f) SELECT key, min(path) AS path FROM k GROUP BY key HAVING count(*) = 1")
def unique_basename(spark, sf):
    return resolve.unique_by(files(spark, sf), F.lower(F.regexp_replace(S.basename(F.col("path")), r"_[0-9]+(\.[^.]+)$", "$1")))


@query(f"""
    WITH f AS ({FILES_SQL}), r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM f WHERE NOT starts_with(path, 'config/') UNION SELECT 'config')
    SELECT path, root FROM (SELECT f.path, r.root, row_number() OVER (PARTITION BY f.path ORDER BY length(r.root) DESC NULLS LAST) AS p FROM f LEFT JOIN r ON starts_with(f.path, r.root || '/')) WHERE p = 1
""")
def longest_prefix_owner(spark, sf):
    f = files(spark, sf).select("path")
    roots = f.filter(~F.col("path").startswith("config/")).select(S.parent(F.col("path")).alias("root")).unionByName(f.sparkSession.createDataFrame([("config",)], "root string")).distinct()
    return graph.longest_owner(f, roots)


@query("""
    SELECT a.o_orderkey IS NULL AS is_new, b.o_orderkey IS NULL AS is_deleted, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey
    FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0) b ON a.o_orderkey = b.o_orderkey
    WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice
""")
def change_set(spark, sf):
    from ..sources.listing import change_set as changes

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"))
    now = o.filter("path % 5 <> 0").withColumn("size", F.when(F.col("path") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")))
    found = changes(now, o.filter("path % 7 <> 0"), keys=["path"], compare=["size"])
    return found.select((F.col("change") == "new").alias("is_new"), (F.col("change") == "deleted").alias("is_deleted"), F.col("path").alias("o_orderkey"))


def _linked_sql(part: str, order: str, line: str) -> str:
    """Edges of order notes to the parts of their lines: by path, else by a name in the attic, else by the only note of the number."""
    return f"""
        SELECT DISTINCT 'orders/' || l_orderkey || '.md' AS source, CASE WHEN {part.format('l_partkey')} THEN 'parts/' || l_partkey || '.py' WHEN l_partkey % 10 = 0 THEN 'attic/' || l_partkey || '.py' ELSE 'orders/' || l_partkey || '.md' END AS target
        FROM lineitem WHERE {order.format('l_orderkey')} AND ({line}) AND l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)
        AND ({part.format('l_partkey')} OR l_partkey % 10 = 0 OR (l_partkey <> l_orderkey AND {order.format('l_partkey')} AND l_partkey IN (SELECT o_orderkey FROM orders)))
    """


def _note_facts(tree):
    """Facts of tree(project_id, path, parts): a note refers to the files of its parts."""
    refs = F.transform("parts", lambda k: F.struct(F.lit("references").alias("relation"), F.lit("document").alias("how"), F.concat(F.lit("../parts/"), k, F.lit(".py")).alias("value")))
    return tree.select("project_id", "path", refs.alias("references"), F.array().cast("array<string>").alias("external"), F.lit("{}").alias("metadata"))


@query(f"""
    WITH a AS ({_linked_sql('{} % 7 <> 0', '{} % 11 <> 0', 'true')}), b AS ({_linked_sql('{} % 5 <> 0', '{} % 13 <> 0', 'l_orderkey % 3 <> 0 OR l_quantity > 25')})
    SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, CASE WHEN a.source IS NULL THEN 'inserted' WHEN b.source IS NULL THEN 'deleted' ELSE 'kept' END AS change
    FROM a FULL JOIN b ON a.source = b.source AND a.target = b.target
""")
def edges_by_difference(spark, sf):
    """A tree of notes and parts is scanned; files come, go and change; edges follow from the change set and the stored references."""
    p, o, part = table(spark, sf, "part"), table(spark, sf, "orders"), F.col("l_partkey")
    lines = table(spark, sf, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    said = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(part)).alias("then"), F.array_sort(F.collect_set(F.when(F.expr("l_orderkey % 3 <> 0 OR l_quantity > 25"), part))).alias("now"))
    notes, none = stored(o.select("o_orderkey").join(said, "o_orderkey", "left"), "notes"), F.array().cast("array<bigint>")
    row = lambda df, folder, key, end, parts: df.select(F.lit("p").alias("project_id"), F.concat(F.lit(folder), key, F.lit(end)).alias("path"), F.coalesce(parts, none).alias("parts"))
    tree = lambda orders, parts, of: row(notes.filter(orders), "orders/", "o_orderkey", ".md", F.col(of)).unionByName(row(p.filter(parts), "parts/", "p_partkey", ".py", none)).unionByName(row(p.filter("p_partkey % 10 = 0"), "attic/", "p_partkey", ".py", none))
    then, now = tree("o_orderkey % 11 <> 0", "p_partkey % 7 <> 0", "then"), tree("o_orderkey % 13 <> 0", "p_partkey % 5 <> 0", "now")
    changes = stored(listing.change_set(now, then, ["project_id", "path"], ["parts"]), "changes")
    before = references.state(_note_facts(then)).stored()
    fresh = now.join(changes.filter("change <> 'deleted'"), ["project_id", "path"], "left_semi")
    _, found = references.update(before, _note_facts(fresh), changes)
    return found.edges.select("source", "target", "change")


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 3)")
def dependents_semi(spark, sf):
    gone = table(spark, sf, "part").filter("p_size < 3").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(gone, "l_partkey", "left_semi").select("l_orderkey").distinct()


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def deleted_anti(spark, sf):
    seen = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(seen, "p_partkey", "left_anti")


@query(f"WITH e AS ({_EDGES.replace('FROM lineitem', 'FROM lineitem WHERE l_quantity > 49')}), n AS ({_NODES}) SELECT id, key FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE source_id = id OR target_id = id)")
def orphan_anti(spark, sf):
    nodes, _ = _part_edges(spark, sf)
    li = table(spark, sf, "lineitem").filter("l_quantity > 49")
    o = F.concat(F.lit("o"), "l_orderkey")
    edges = li.select(o.alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id")).unionByName(li.select(o.alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id")))
    return graph.unlinked(nodes, edges).select("id", "key")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderpriority END AS label, o_orderdate AS created_at FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT o_orderkey, 'new', TIMESTAMP '2030-01-01' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0
""")
def node_upsert(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("created_at"))
    new = o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("label"), F.lit("2030-01-01").cast("timestamp_ntz").alias("created_at"))
    return graph.upsert(old, new, ["o_orderkey"])


@query("SELECT source AS concept_key, sum(n)::BIGINT AS file_count, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS languages FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def concept_group_stats(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("p").alias("project_id"), F.col("source").alias("concept_key"), F.col("lang").alias("language"))
    return semantic.concept_stats(d).select("concept_key", "file_count", F.array_join(F.transform("languages", lambda x: F.concat(x["language"], F.lit(":"), x["n"])), ",").alias("languages"))


@query("""
    WITH e AS (SELECT a.l_partkey AS source, CASE WHEN a.l_linenumber < b.l_linenumber THEN 'references' ELSE 'imports' END AS relation, b.l_partkey AS target
               FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
    c AS (SELECT p.p_brand AS source_concept, q.p_brand AS target_concept, relation, source, target FROM e JOIN part p ON source = p.p_partkey JOIN part q ON target = q.p_partkey WHERE p.p_brand <> q.p_brand),
    g AS (SELECT source_concept, target_concept, CASE WHEN bool_and(relation = 'references') THEN 'related_to' ELSE 'depends_on' END AS relation, count(*) AS n FROM c GROUP BY source_concept, target_concept),
    v AS (SELECT source_concept, target_concept, string_agg(source || ' ' || relation || ' ' || target, ',' ORDER BY p) AS evidence
          FROM (SELECT *, row_number() OVER (PARTITION BY source_concept, target_concept ORDER BY source, target, relation) AS p FROM c) WHERE p <= 20 GROUP BY source_concept, target_concept)
    SELECT source_concept, target_concept, relation, n, round(least(0.97, 0.55 + 0.08 * greatest(n, 1))::DOUBLE, 6) AS confidence, evidence FROM g JOIN v USING (source_concept, target_concept)
""")
def concept_edge_agg(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    a = li.select("l_orderkey", F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("i"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("j"))
    edges = a.join(b, "l_orderkey").filter("source < target").select("source", F.when(F.col("i") < F.col("j"), "references").otherwise("imports").alias("relation"), "target")
    got = semantic.concept_edges(edges, table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("concept_key")))
    return got.withColumn("evidence", F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["source"].cast("string"), e["relation"], e["target"].cast("string"))), ","))


@query("""
    WITH d AS (SELECT p_brand AS concept_key, count(DISTINCT p_partkey) AS file_count FROM part WHERE p_size > 48 AND p_retailprice > 1000 AND p_partkey % 3 = 0 GROUP BY p_brand)
    SELECT concept_key, true AS active, file_count FROM d UNION ALL SELECT DISTINCT p_brand, false, 0 FROM part WHERE p_brand NOT IN (SELECT concept_key FROM d)
""")
def stale_concepts(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.filter("p_size > 48 AND p_retailprice > 1000 AND p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("concept_key")).agg(F.count_distinct("p_partkey").alias("file_count"))
    return semantic.retire(part.select(F.col("p_brand").alias("concept_key")).distinct(), wanted)


@query("""
    WITH f AS (SELECT p_brand AS concept_key, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS path, string_split(p_type, ' ') AS a, ['size ' || p_size, ' '] AS b, list_concat(string_split(p_name, ' '), [CAST(p_partkey % 997 AS VARCHAR)]) AS c FROM part),
    v AS (SELECT concept_key, path, 0 AS f, unnest(a) AS value, generate_subscripts(a, 1) - 1 AS i FROM f UNION ALL SELECT concept_key, path, 1, unnest(b), generate_subscripts(b, 1) - 1 FROM f UNION ALL SELECT concept_key, path, 2, unnest(c), generate_subscripts(c, 1) - 1 FROM f),
    m AS (SELECT concept_key, trim(value) AS value, min((path, f, i)) AS place FROM v WHERE trim(value) <> '' GROUP BY ALL),
    o AS (SELECT p_brand AS concept_key, p_brand || ' own' AS value FROM part GROUP BY p_brand),
    e AS (SELECT concept_key, value, 0 AS own, NULL AS place FROM o UNION ALL SELECT concept_key, value, 1, place FROM m),
    r AS (SELECT concept_key, value, row_number() OVER (PARTITION BY concept_key ORDER BY own, place, value) AS n FROM e)
    SELECT concept_key, string_agg(value, '|' ORDER BY n) AS keywords, count(*) AS n FROM r WHERE n <= 150 GROUP BY concept_key
""")
def concept_keywords(spark, sf):
    """Keywords of brands: what each has, then entries of the metadata lists of its parts in order, 150 at most."""
    p = table(spark, sf, "part")
    metadata = F.to_json(F.struct(F.split("p_type", " ").alias("columns"), F.array(F.concat(F.lit("size "), F.col("p_size")), F.lit(" ")).alias("top_level_keys"), F.concat(F.split("p_name", " "), F.array((F.col("p_partkey") % 997).cast("string"))).alias("sections")))
    files = p.select(F.col("p_brand").alias("concept_key"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("path"), metadata.alias("metadata"))
    own = p.select(F.col("p_brand").alias("concept_key")).distinct().withColumn("keywords", F.array(F.concat("concept_key", F.lit(" own"))))
    got = semantic.concept_keywords(files, own, ("concept_key",))
    return got.select("concept_key", F.array_join("keywords", "|").alias("keywords"), F.size("keywords").cast("long").alias("n"))


@query("SELECT p_brand AS concept_key, role, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_type, ' ')) AS role FROM part) GROUP BY p_brand, role")
def role_counts(spark, sf):
    return semantic.role_counts(table(spark, sf, "part").select(F.col("p_brand").alias("concept_key"), F.split("p_type", " ").alias("roles")))


_OVERLAY = """
    SELECT event_id AS seq, [{actions}][1 + event_id % 11] AS action, 'c' || (user_id % 20) AS subject_key, 'depends_on' AS relation, 'c' || (user_id % 7) AS object_key, event_type AS value FROM events
""".format(actions=", ".join(f"'{a}'" for a in fixed.OVERLAY_ACTIONS))


def _overlay(spark, sf):
    actions = F.array(*[F.lit(a) for a in fixed.OVERLAY_ACTIONS])
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.element_at(actions, (F.col("event_id") % 11 + 1).cast("int")).alias("action"), F.concat(F.lit("c"), F.col("user_id") % 20).alias("subject_key"), F.lit("depends_on").alias("relation"), F.concat(F.lit("c"), F.col("user_id") % 7).alias("object_key"), F.col("event_type").alias("value"))


@query(f"""
    WITH o AS ({_OVERLAY}), s AS (SELECT *, CASE WHEN action IN ('accept_concept', 'reject_concept') THEN 'decision' WHEN action IN ('add_edge', 'accept_edge', 'reject_edge') THEN 'edge' WHEN action IN ('map_file', 'unmap_file') THEN 'file' ELSE action END
        || '|' || subject_key || '|' || CASE WHEN action IN ('add_edge', 'accept_edge', 'reject_edge', 'map_file', 'unmap_file') THEN object_key ELSE '' END || '|' || CASE WHEN action = 'add_alias' THEN value ELSE '' END AS slot FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY seq DESC) AS p, min(seq) OVER (PARTITION BY slot) AS first FROM s)
    SELECT seq, action, subject_key, CASE WHEN action = 'add_alias' THEN first ELSE seq END AS order_seq FROM r WHERE p = 1
""")
def overlay_slot_lww(spark, sf):
    return overlay.last_per_slot(_overlay(spark, sf)).select("seq", "action", "subject_key", "order_seq")


@query("""
    WITH e AS (SELECT DISTINCT 'b' || l_partkey % 25 AS source, 'depends_on' AS relation, 'b' || l_suppkey % 25 AS target FROM lineitem WHERE l_partkey % 25 <> l_suppkey % 25),
    d AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN 'reject_edge' ELSE 'accept_edge' END AS action, 'b' || user_id % 25 AS source, 'depends_on' AS relation, 'b' || user_id % 11 AS target FROM events),
    k AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = e.source AND d.target = e.target))
    SELECT source, relation, target, 0.55::DOUBLE AS confidence, 'semantic-heuristic' AS origin FROM k UNION ALL SELECT DISTINCT source, relation, target, 1.0, 'human-overlay' FROM d WHERE action = 'accept_edge'
""")
def overlay_apply_reject_accept(spark, sf):
    li, ev = table(spark, sf, "lineitem"), table(spark, sf, "events")
    edges = li.filter("l_partkey % 25 <> l_suppkey % 25").select(F.concat(F.lit("b"), F.col("l_partkey") % 25).alias("source"), F.lit("depends_on").alias("relation"), F.concat(F.lit("b"), F.col("l_suppkey") % 25).alias("target")).distinct().withColumn("confidence", F.lit(0.55)).withColumn("origin", F.lit("semantic-heuristic"))
    decisions = ev.select(F.when(F.col("user_id") % 3 == 0, "reject_edge").otherwise("accept_edge").alias("action"), F.concat(F.lit("b"), F.col("user_id") % 25).alias("source"), F.lit("depends_on").alias("relation"), F.concat(F.lit("b"), F.col("user_id") % 11).alias("target")).distinct()
    return overlay.apply_edges(edges, decisions)


@query("""
    WITH e AS (SELECT p_brand AS source, 'depends_on' AS relation, 'Brand#' || (11 + l_suppkey % 5) AS target FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#13'), ('Brand#12', 'Brand#13')) AS t(old, new)),
    r AS (SELECT coalesce(a.new, source) AS source, relation, coalesce(b.new, target) AS target FROM e LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target)
    SELECT source, relation, target, count(*) AS n FROM r WHERE source <> target GROUP BY source, relation, target
""")
def merge_repoint(spark, sf):
    """A merge chain 11 into 12 into 13 and its echo, resolved on the driver; the edges are rewritten by joins."""
    final = overlay.merge_map([("Brand#11", "Brand#12"), ("Brand#12", "Brand#13"), ("Brand#13", "Brand#11")])
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    edges = li.select(F.col("p_brand").alias("source"), F.lit("depends_on").alias("relation"), F.concat(F.lit("Brand#"), 11 + F.col("l_suppkey") % 5).alias("target")).groupBy("source", "relation", "target").agg(F.count(F.lit(1)).alias("n"))
    return overlay.repoint(edges, spark.createDataFrame(sorted(final.items()), "old string, new string"))


@query("""
    WITH c AS (SELECT DISTINCT p_brand AS key, (p_partkey % 1 + 0.78)::DOUBLE AS confidence FROM part), e AS (SELECT p_brand AS source, 'depends_on' AS relation, p_type AS target, round(least(0.97, 0.55 + 0.08 * count(*))::DOUBLE, 6) AS confidence FROM part GROUP BY p_brand, p_type),
    k AS (SELECT 'concept' AS kind, key AS subject, '' AS relation, '' AS object, confidence FROM c UNION ALL SELECT 'edge', source, relation, target, confidence FROM e),
    d AS (SELECT DISTINCT 'concept|' || p_brand || '||' AS slot_key, 'accept_concept' AS action FROM part WHERE p_brand LIKE '%3')
    SELECT kind, subject, relation, object, confidence, action IS NOT NULL AS decided, coalesce(action, '') AS action FROM k LEFT JOIN d ON slot_key = kind || '|' || subject || '|' || relation || '|' || object
    ORDER BY decided, confidence, kind, subject, relation, object LIMIT 40
""")
def review_queue(spark, sf):
    p = table(spark, sf, "part")
    concepts = p.select(F.col("p_brand").alias("key")).distinct().select("key", F.lit(0.78).alias("confidence"), F.lit(True).alias("active"))
    edges = p.groupBy(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).agg(F.count(F.lit(1)).alias("n")).select("source", F.lit("depends_on").alias("relation"), "target", F.round(S.edge_confidence(F.col("n")), 6).alias("confidence"))
    decisions = p.filter(F.col("p_brand").endswith("3")).select(F.concat(F.lit("concept|"), "p_brand", F.lit("||")).alias("slot_key"), F.lit("accept_concept").alias("action")).distinct()
    return overlay.review_queue(concepts, edges, decisions, 40)


@query("""
    WITH hit AS (SELECT DISTINCT p_brand, min(p_partkey) OVER (PARTITION BY p_brand) AS r FROM part WHERE contains(lower(p_name), 'alpha') OR contains(lower(p_type), 'promo')),
    top AS (SELECT p_brand FROM hit ORDER BY r, p_brand LIMIT 5), direct AS (SELECT p_partkey AS path, 0 AS pr FROM part WHERE contains(lower(p_name), 'alpha') OR contains(lower(p_type), 'promo')),
    own AS (SELECT p_partkey, 1 FROM part WHERE p_brand IN (SELECT p_brand FROM top)), hop AS (SELECT b.l_partkey, 2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey IN (SELECT path FROM direct)),
    u AS (SELECT path, min(pr) AS pr FROM (SELECT * FROM direct UNION ALL SELECT * FROM own UNION ALL SELECT * FROM hop) GROUP BY path)
    SELECT path, CAST(pr AS BIGINT) AS priority FROM u ORDER BY pr, path LIMIT 12
""")
def context_files(spark, sf):
    """Files for a query: direct hits, then files of the best concepts, then one hop; the first source of a file wins."""
    from ..operators.search import prioritized

    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    hits = p.filter(F.contains(F.lower("p_name"), F.lit("alpha")) | F.contains(F.lower("p_type"), F.lit("promo"))).select("p_partkey", "p_brand")
    top = hits.groupBy("p_brand").agg(F.min("p_partkey").alias("r")).orderBy("r", "p_brand").limit(5).select("p_brand")
    own = p.join(top, "p_brand", "left_semi").select(F.col("p_partkey").alias("path"))
    near = li.join(hits.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey").distinct()
    hop = li.join(near, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("path"))
    return prioritized([hits.select(F.col("p_partkey").alias("path")), own, hop], 12)


@query()
def concept_paths_unicode(spark, sf):
    """Files with their concept keys and labels by the Unicode slug."""
    importable(spark)
    f = files(spark, sf).withColumn("project_id", F.lit("tree"))
    return semantic.file_concepts(f).groupBy("concept_key", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey, s_suppkey, place FROM (SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place FROM supplier) WHERE place <= 3")
def top_per_group(spark, sf):
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return table(spark, sf, "supplier").withColumn("place", place).filter("place <= 3").select("s_nationkey", "s_suppkey", F.col("place").cast("long").alias("place"))
