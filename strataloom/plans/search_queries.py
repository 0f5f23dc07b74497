"""Scalars, search, paths and formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S
from ..operators import grams, search, semantic
from ..runtime import importable, table
from .registry import query
from .standins import FILES_SQL, files

QUERY = "the nation theat and from"
TERMS = S.search_terms(QUERY)
CJK_QUERY = "修改会员升级和支付逻辑 src/payment service.py"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_quoted(v) for v in values) + ")"


@query("SELECT doc_id, 'node_' || sha1('documents' || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || coalesce(lang, '')) AS node_id FROM documents")
def stable_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.stable_id("node_", F.lit("documents"), F.col("doc_id"), F.col("lang")).alias("node_id"))


@query(r"""
    SELECT p_partkey, CASE WHEN s = '' THEN 'item' ELSE s END AS slug,
           trim(regexp_replace(regexp_replace(regexp_replace(p_type || '_' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS human
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_name || '!')), '\s+', '-', 'g'), '[^0-9a-z_\-]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS s FROM part)
""")
def slug_and_humanize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.slug_ascii(F.concat("p_brand", F.lit(" "), "p_name", F.lit("!"))).alias("slug"), S.humanize(F.concat("p_type", F.lit("_"), "p_name")).alias("human"))


@query(r"""
    WITH q AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || '修改会员升级和支付逻辑' AS q FROM part),
    t AS (SELECT p_partkey, list_distinct(list_concat([lower(q)], list_transform(regexp_extract_all(q, '[A-Za-z0-9_.\-/]{2,}'), lambda x: lower(x)),
          flatten(list_transform([6,5,4,3,2], lambda n: list_transform(range(1, 11 - n + 2), lambda i: substring('修改会员升级和支付逻辑', i, n)))))) AS terms FROM q),
    u AS (SELECT p_partkey, unnest(terms) AS term FROM t),
    r AS (SELECT p_partkey, term, row_number() OVER (PARTITION BY p_partkey ORDER BY length(term) DESC, term) AS place FROM u)
    SELECT p_partkey, place, term FROM r WHERE place <= 18
""")
def search_terms_ngrams(spark, sf):
    q = table(spark, sf, "part").select("p_partkey", S.search_terms_column(F.concat("p_brand", F.lit(" "), "p_name", F.lit(" 修改会员升级和支付逻辑"))).alias("terms"))
    return q.select("p_partkey", F.posexplode("terms").alias("p", "term")).select("p_partkey", (F.col("p") + 1).cast("long").alias("place"), "term")


def _score_sql(terms, whole, label, key, data, base) -> str:
    out = f"{base} + CASE WHEN contains({label}, {_quoted(whole)}) THEN 12.0 ELSE 0.0 END + CASE WHEN contains({key}, {_quoted(whole)}) THEN 8.0 ELSE 0.0 END"
    for t in map(_quoted, terms):
        out += f" + CASE WHEN {label} = {t} THEN 9.0 WHEN contains({label}, {t}) THEN 5.0 ELSE 0.0 END + CASE WHEN {key} = {t} THEN 6.0 WHEN contains({key}, {t}) THEN 3.0 ELSE 0.0 END + CASE WHEN contains({data}, {t}) THEN 1.0 ELSE 0.0 END"
    return f"CAST({out} AS DOUBLE)"


@query(f"""
    WITH d AS (SELECT doc_id, lower(source) AS l, CAST(doc_id AS VARCHAR) AS k, lower(text) AS t FROM documents)
    SELECT doc_id, {_score_sql(TERMS, QUERY, 'l', 'k', 't', '2.0')} AS score FROM d
    WHERE {' OR '.join(f"contains({c}, {_quoted(t)})" for t in TERMS for c in ('l', 'k', 't'))}
    ORDER BY score DESC, doc_id LIMIT 30
""")
def node_search_topk(spark, sf):
    d = table(spark, sf, "documents")
    label, key, text = F.col("source"), F.col("doc_id").cast("string"), F.col("text")
    score = S.node_score(TERMS, QUERY, label, key, text, F.lit(1), F.lit(False))
    return d.filter(S.matches(TERMS, label, key, text)).select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(30)


@query("""
    SELECT page_id, p_name FROM pages, (SELECT DISTINCT unnest(string_split(trim(p_name), ' ')) AS p_name FROM part) p WHERE length(p_name) >= 2 AND contains(lower(url || ' ' || html), lower(p_name))
    UNION ALL SELECT page_id, r_name FROM pages, region WHERE contains(lower(url || ' ' || html), lower(r_name))
""")
def reverse_containment(spark, sf):
    """Words of names that a text contains, by the gram index."""
    names = table(spark, sf, "part").select(F.explode(F.split(F.trim("p_name"), " ")).alias("p_name")).filter(F.length("p_name") >= 2).distinct().unionByName(table(spark, sf, "region").select(F.col("r_name").alias("p_name")))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat("url", F.lit(" "), "html").alias("text"))
    return grams.containing(pages, names.withColumnRenamed("p_name", "pattern")).select(F.col("id").alias("page_id"), F.col("pattern").alias("p_name"))


TASK_TERMS = S.search_terms("the theat")


@query(f"""
    WITH c AS (SELECT conv_id, turn, role, lower(text) AS t, lower(role) AS title FROM conversations),
    s AS (SELECT conv_id, turn, CAST({' + '.join(f"CASE WHEN contains(title, {_quoted(t)}) THEN 5 WHEN contains(t, {_quoted(t)}) THEN 1 ELSE 0 END" for t in TASK_TERMS)} AS BIGINT) AS score FROM c)
    SELECT conv_id, turn, score FROM s WHERE score > 0 ORDER BY score DESC, turn, conv_id LIMIT 20
""")
def task_search_topk(spark, sf):
    c = table(spark, sf, "conversations")
    score = F.lit(0)
    for t in TASK_TERMS:
        score = score + F.when(F.contains(F.lower("role"), F.lit(t)), 5).when(F.contains(F.lower("text"), F.lit(t)), 1).otherwise(0)
    return c.select("conv_id", "turn", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "turn", "conv_id").limit(20)


FILE_TERMS = S.search_terms("brand_13 test config building src/brand_13")


@query(f"""
    WITH f AS ({FILES_SQL}), s AS (SELECT path, round({' + '.join(f"CASE WHEN lower(path) = {_quoted(t)} OR lower(concept) = {_quoted(t)} THEN 10.0 WHEN contains(lower(path), {_quoted(t)}) THEN {4.0 + min(len(t), 10) / 10} WHEN contains(lower(concept), {_quoted(t)}) THEN 3.0 ELSE 0.0 END" for t in FILE_TERMS)}, 6) AS score FROM f)
    SELECT path, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 50
""")
def filename_score(spark, sf):
    f = files(spark, sf)
    return f.select("path", F.round(S.filename_score(FILE_TERMS, F.col("path"), F.col("concept")), 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), "path").limit(50)


_LANG_SQL = " ".join(f"WHEN e IN {_in(v)} THEN '{k}'" for k, v in fixed.LANGUAGES.items())


@query(f"""
    WITH f AS ({FILES_SQL}), s AS (SELECT path, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS e FROM f)
    SELECT language, count(*) AS n FROM (SELECT CASE {_LANG_SQL} WHEN e = '' THEN NULL ELSE substring(e, 2) END AS language FROM s) GROUP BY language
""")
def language_lookup(spark, sf):
    return files(spark, sf).select(S.language(F.col("path")).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_TEST_SQL = " OR ".join(f"contains('/' || lower(path), '{m}')" for m in fixed.TEST_MARKERS)


@query(f"""
    WITH f AS ({FILES_SQL}), s AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS e, CASE WHEN path LIKE 'docs/%' THEN ['media_asset', 'document'] WHEN path LIKE 'config/%' THEN ['unknown', 'manifest'] ELSE ['source_code'] END AS roles FROM f)
    SELECT path, CASE WHEN {_TEST_SQL} THEN 'tested_by' WHEN e IN {_in(fixed.DOCUMENT_EXTENSIONS)} OR contains('/' || lower(path), '/docs/') THEN 'documented_by'
           WHEN e IN {_in(fixed.CONFIG_EXTENSIONS)} OR contains('/' || lower(path), '/config/') THEN 'configured_by' ELSE 'implemented_by' END AS relation,
           CASE WHEN {_TEST_SQL} THEN 'tested_by' WHEN roles[1] = 'media_asset' THEN 'uses_asset' WHEN roles[2] = 'manifest' THEN 'configured_by' END AS role_relation
    FROM s
""")
def file_relation_case(spark, sf):
    p = F.col("path")
    roles = F.when(p.startswith("docs/"), F.array(F.lit("media_asset"), F.lit("document"))).when(p.startswith("config/"), F.array(F.lit("unknown"), F.lit("manifest"))).otherwise(F.array(F.lit("source_code")))
    return files(spark, sf).select("path", S.path_relation(p).alias("relation"), S.role_relation(p, roles).alias("role_relation"))


@query(f"""
    WITH f AS ({FILES_SQL}), s AS (SELECT path, list_filter(string_split(path, '/')[1:-2], lambda x: lower(x) NOT IN {_in(fixed.GENERIC_PREFIXES + fixed.GENERIC_SEGMENTS)}) AS d,
        regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]+$', ''), '^test_', '') AS stem FROM f)
    SELECT path, trim(coalesce(d[1], stem), '-_. ') AS concept FROM s
""")
def concept_for_path(spark, sf):
    return files(spark, sf).select("path", S.concept_name(F.col("path"), F.lit("project")).alias("concept"))


@query(r"""
    SELECT event_id, CASE WHEN v IS NULL OR trim(v) = '' THEN 'empty' WHEN lower(trim(v)) IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(trim(v), '^[+-]?[0-9]+(_[0-9]+)*$') THEN 'integer'
        WHEN regexp_matches(trim(v), '^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$') OR regexp_matches(lower(trim(v)), '^[+-]?(nan|inf|infinity)$') THEN 'number' ELSE 'string' END AS kind
    FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN event_type WHEN 2 THEN '' WHEN 3 THEN 'True' WHEN 4 THEN ' 1e3 ' WHEN 5 THEN 'nan' ELSE '1_0' END AS v FROM events)
""")
def csv_type_inference(spark, sf):
    k = F.col("event_id") % 7
    v = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.col("event_type")).when(k == 2, "").when(k == 3, "True").when(k == 4, " 1e3 ").when(k == 5, "nan").otherwise("1_0")
    return table(spark, sf, "events").select("event_id", S.scalar_type(v).alias("kind"))


@query("SELECT k AS key, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest(json_keys(props)) AS k FROM events) GROUP BY k")
def json_key_stats(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query(r"""
    WITH s AS (SELECT p_partkey, 'INSERT INTO ' || replace(p_brand, '#', '_') || ' SELECT * FROM sales JOIN customer ON 1=1 JOIN Sales ON 2=2; update stock set x=1' AS q FROM part)
    SELECT p_partkey, array_to_string(regexp_extract_all(q, '(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][\w.$\-]*(?:\.[A-Za-z_][\w$\-]*)?)', 1), ',') AS reads,
           array_to_string(regexp_extract_all(q, '(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO|CREATE\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE)\s+([A-Za-z_][\w.$\-]*(?:\.[A-Za-z_][\w$\-]*)?)', 1), ',') AS writes
    FROM s
""")
def sql_table_refs(spark, sf):
    q = F.concat(F.lit("INSERT INTO "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(" SELECT * FROM sales JOIN customer ON 1=1 JOIN Sales ON 2=2; update stock set x=1"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.sql_reads(q), ",").alias("reads"), F.array_join(S.sql_writes(q), ",").alias("writes"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def html_refs(spark, sf):
    refs = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return refs.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT p.page_id, h.href FROM pages p LEFT JOIN (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) h ON p.page_id = h.page_id
""")
def explode_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode_outer(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("href"))


@query("""
    WITH d AS (SELECT source, doc_id, text, octet_length(encode(text)) AS b FROM documents),
    s AS (SELECT doc_id, b > 4096 AS oversized, sum(CASE WHEN b > 4096 THEN 0 ELSE b END) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM d)
    SELECT doc_id, oversized, CAST(used AS BIGINT) AS used, used > 65536 AS stopped FROM s
""")
def doc_budget_flags(spark, sf):
    """Line and stream budgets: long lines count as blank, and a source stops when its budget is spent."""
    b = F.octet_length("text").cast("long")
    used = F.sum(F.when(F.col("b") > 4096, 0).otherwise(F.col("b"))).over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf, "documents").select("source", "doc_id", b.alias("b")).withColumn("used", used)
    return d.select("doc_id", (F.col("b") > 4096).alias("oversized"), "used", (F.col("used") > 65536).alias("stopped"))


@query("""
    SELECT r_name AS note, '# ' || r_name || chr(10) || string_agg('- [[' || n_name || ']]', chr(10) ORDER BY n_name) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name
""")
def vault_note_text(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("note")).agg(lines.alias("lines")).select("note", F.concat(F.lit("# "), "note", F.lit("\n"), "lines").alias("body"))


@query()
def slug_nfkc(spark, sf):
    """Unicode slugs; SQL engines lack the normalisation."""
    importable(spark)
    return table(spark, sf, "documents").select("doc_id", S.slug(F.col("text")).alias("slug"))


@query(f"""
    WITH f AS ({FILES_SQL}), t AS (SELECT concept, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '') AS title, path LIKE 'docs/%' AS d FROM f)
    SELECT concept AS concept_key, title AS label FROM (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY CASE WHEN d THEN 0 ELSE 1 END, length(title), title) AS p FROM t) WHERE p = 1
""")
def concept_label_pick(spark, sf):
    f = files(spark, sf).select(F.col("concept").alias("concept_key"), S.stem(F.col("path")).alias("title"), F.col("path").startswith("docs/").alias("is_document"))
    return semantic.label_pick(f)


@query("""
    WITH t AS (SELECT source, doc_id, string_split_regex(text, '[^\\x21-\\x{10FFFF}]+') AS words FROM documents),
    d AS (SELECT source, doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM t),
    f AS (SELECT source, word, min((doc_id, i)) AS first FROM d WHERE word <> '' GROUP BY source, word),
    r AS (SELECT source, word, row_number() OVER (PARTITION BY source ORDER BY first, word) AS place FROM f)
    SELECT source, word, place FROM r WHERE place <= 100
""")
def keyword_distinct_ordered(spark, sf):
    """The first hundred distinct words of the texts of each source, in the order in which they first occur."""
    words = F.split("text", r"[^\x21-\x{10FFFF}]+")
    d = table(spark, sf, "documents").select("source", "doc_id", F.posexplode(words).alias("i", "word")).filter("word <> ''")
    first = d.groupBy("source", "word").agg(F.min(F.struct("doc_id", "i")).alias("first"))
    return semantic.ordered_distinct(first, "source", "word", "first", 100).withColumn("place", F.col("place").cast("long"))
