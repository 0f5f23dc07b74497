"""The task log, evaluation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate, tasklog
from ..runtime import importable, table
from .registry import query
from .standins import EVENTS_SQL, log

_ACTIVE = f"""
    WITH e AS ({EVENTS_SQL}),
    s AS (SELECT *, last_value(CASE WHEN marker = 'start' THEN seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS started FROM e),
    m AS (SELECT *, CASE WHEN marker = 'start' THEN seq WHEN marker = 'stop' AND started IS NOT NULL THEN -1 END AS effect FROM s),
    a AS (SELECT *, nullif(last_value(effect IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS active_task FROM m)
"""


@query(_ACTIVE + "SELECT seq, session, active_task FROM a")
def asof_active_task(spark, sf):
    return tasklog.active_task(log(spark, sf)).select("seq", "session", "active_task")


def _touches(spark, sf):
    a = tasklog.active_task(log(spark, sf)).filter("marker IS NULL AND active_task IS NOT NULL")
    relation = F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "view", "searched").otherwise("modified")
    return a.select(F.col("active_task").alias("task"), relation.alias("relation"), F.concat(F.lit("f"), F.col("seq") % 5).alias("path"), "seq", "created_at")


_TOUCH = _ACTIVE + ", t AS (SELECT active_task AS task, CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'searched' ELSE 'modified' END AS relation, 'f' || seq % 5 AS path, seq, created_at FROM a WHERE marker IS NULL AND active_task IS NOT NULL) "


@query(_TOUCH + "SELECT task, relation, path, count(*) AS n, arg_max(created_at, seq) AS last_seen_at FROM t GROUP BY task, relation, path")
def task_edge_counts(spark, sf):
    return tasklog.task_edges(_touches(spark, sf))


@query("SELECT user_id AS session, min(ts) AS created_at, arg_max(ts, event_id) AS updated_at, CASE WHEN arg_max(event_type, event_id) = 'error' THEN arg_max(ts, event_id) END AS ended_at, count(*) AS events FROM events GROUP BY user_id")
def session_fold(spark, sf):
    e = log(spark, sf).withColumn("ends", F.col("event_type") == "error")
    return tasklog.session_fold(e)


@query(_ACTIVE + """, c AS (SELECT seq AS task, 'task ' || seq AS title, created_at FROM e WHERE marker = 'start'), x AS (SELECT started AS task, max(created_at) AS closed_at, arg_max(CASE WHEN seq % 2 = 0 THEN 'failed' ELSE 'completed' END, seq) AS status FROM s WHERE marker = 'stop' AND started IS NOT NULL GROUP BY started)
    SELECT task, title, created_at, coalesce(status, 'running') AS status, closed_at FROM c LEFT JOIN x USING (task)""")
def task_fold(spark, sf):
    e = log(spark, sf)
    created = e.filter("marker = 'start'").select("task", "seq", "created_at", F.concat(F.lit("task "), "task").alias("title"))
    closed = e.filter("marker = 'stop' AND task IS NOT NULL").select("task", "seq", "created_at", F.when(F.col("seq") % 2 == 0, "failed").otherwise("completed").alias("status"))
    return tasklog.task_fold(created, closed)


@query("SELECT * FROM (SELECT user_id AS session, event_id AS task, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next_task FROM events WHERE event_type = 'signup') WHERE next_task IS NOT NULL")
def interrupted_tasks(spark, sf):
    return tasklog.interrupted(log(spark, sf).filter("marker = 'start'").select("session", "seq", "task")).select("session", "task", "next_task")


_LINES = "SELECT CASE WHEN event_id % 50 = 0 THEN event_id - 1 ELSE event_id END AS event_id, event_type, user_id % 4 AS project_id, CASE WHEN event_id % 33 = 0 THEN 'invalid json' END AS error FROM events"


def _lines(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(F.when(k % 50 == 0, k - 1).otherwise(k).alias("event_id"), "event_type", (F.col("user_id") % 4).alias("project_id"), F.when(k % 33 == 0, "invalid json").alias("error"))


@query(f"WITH l AS ({_LINES}) SELECT count(*) AS lines, count(*) FILTER (error IS NULL) AS valid, count(*) FILTER (error IS NOT NULL) AS invalid, count(event_id) FILTER (error IS NULL) - count(DISTINCT event_id) FILTER (error IS NULL) AS duplicates, count(DISTINCT project_id) FILTER (error IS NULL) AS projects FROM l")
def log_verify(spark, sf):
    return tasklog.verify(_lines(spark, sf))


@query(f"WITH l AS ({_LINES}) SELECT event_type, count(*) AS n FROM l WHERE error IS NULL GROUP BY event_type")
def log_type_histogram(spark, sf):
    return _lines(spark, sf).filter("error IS NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'invalid json' WHEN event_id % 6 = 1 THEN 'unsupported schema_version' WHEN event_id % 6 = 2 THEN 'unknown event_type' WHEN event_id % 6 = 3 THEN 'missing project' WHEN event_id % 6 = 4 THEN 'missing payload' END AS error FROM events""")
def envelope_rules(spark, sf):
    k = F.col("event_id") % 6
    version = F.when(k == 1, "2").otherwise("1")
    kind = F.when(k == 2, "other").otherwise("task_event")
    project = F.when(k == 3, "{}").otherwise('{"id":"p"}')
    payload = F.when(k == 4, "null").otherwise('{"a":1}')
    line = F.concat(F.lit('{"schema_version":'), version, F.lit(',"event_id":"e'), "event_id", F.lit('","event_type":"'), kind, F.lit('","project":'), project, F.lit(',"payload":'), payload, F.when(k == 0, "").otherwise("}"))
    return table(spark, sf, "events").select("event_id", line.alias("value")).select("event_id", tasklog.envelope_error("value").alias("error"))


@query("SELECT event_id, seq FROM (SELECT user_id * 10 + event_id % 10 AS event_id, event_id AS seq, row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY event_id) AS p FROM events) WHERE p = 1 AND event_id % 3 <> 0")
def ledger_anti_apply(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("event_id"), F.col("event_id").alias("seq"))
    return tasklog.unapplied(e, e.filter("event_id % 3 = 0").select("event_id").distinct())


@query("""
    WITH b AS (SELECT 1 AS phase, o_orderdate AS created_at, 'o' || o_orderkey AS event_id FROM orders UNION ALL SELECT 2, l_shipdate, 'l' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_extendedprice::BIGINT FROM (SELECT DISTINCT l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem))
    SELECT event_id, row_number() OVER (ORDER BY phase, created_at, event_id) AS seq FROM b
""")
def backfill_order(spark, sf):
    o = table(spark, sf, "orders").select(F.lit(1).alias("phase"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("o"), "o_orderkey").alias("event_id"))
    li = table(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").distinct()
    li = li.select(F.lit(2).alias("phase"), F.col("l_shipdate").alias("created_at"), F.concat(F.lit("l"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.rint("l_extendedprice").cast("long"))).alias("event_id"))
    return tasklog.backfill_order(o.unionByName(li)).select("event_id", "seq")


# --- Evaluation ---------------------------------------------------------------------------------------------------------

_RUNS = """
    SELECT lang AS run_kind, source AS mode, CAST(doc_id % 60 AS VARCHAR) AS case_key, doc_id AS seq, doc_id % 4 AS created_at, n_chars AS tokens, (CASE WHEN quality = 1 THEN 1.0 ELSE 0.5 END)::DOUBLE AS recall,
           CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 0 END AS success, n_chars % 991 AS input_tokens, CASE WHEN doc_id % 5 > 0 THEN n_chars % 83 END AS output_tokens, CASE WHEN doc_id % 7 > 0 THEN doc_id % 977 END AS duration_ms FROM documents LEFT JOIN labels USING (doc_id)
"""


def _runs(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(F.col("lang").alias("run_kind"), F.col("source").alias("mode"), (F.col("doc_id") % 60).cast("string").alias("case_key"), F.col("doc_id").alias("seq"), (F.col("doc_id") % 4).alias("created_at"), F.col("n_chars").alias("tokens"), F.when(F.col("quality") == 1, 1.0).otherwise(0.5).alias("recall"), (F.col("toxic") == 0).alias("success"),
                    (F.col("n_chars") % 991).alias("input_tokens"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") % 83).alias("output_tokens"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 977).alias("duration_ms"))


_LATEST = f"WITH r AS ({_RUNS}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_key, run_kind, mode ORDER BY created_at DESC, seq) AS p FROM r) WHERE p = 1)"


@query(_LATEST + " SELECT case_key, run_kind, mode, seq FROM l")
def latest_run(spark, sf):
    return evaluate.latest_runs(_runs(spark, sf)).select("case_key", "run_kind", "mode", "seq")


@query(_LATEST + " SELECT run_kind, mode, count(*) AS cases, round(avg(tokens), 6) AS avg_tokens, round(avg(recall), 6) AS avg_recall, round(avg(success::INT), 6) AS success_rate, round(avg(input_tokens), 6) AS avg_input_tokens, round(avg(output_tokens), 6) AS avg_output_tokens, round(avg(duration_ms), 6) AS avg_duration_ms FROM l GROUP BY run_kind, mode")
def suite_summary(spark, sf):
    return evaluate.summary(evaluate.latest_runs(_runs(spark, sf))).withColumns({c: F.round(c, 6) for c in ("avg_tokens", "avg_recall", "success_rate", "avg_input_tokens", "avg_output_tokens", "avg_duration_ms")})


@query(_LATEST + " SELECT run_kind, mode, metric, round(avg(value), 6) AS mean FROM (SELECT run_kind, mode, unnest(['recall', 'tokens']) AS metric, unnest([recall, tokens::DOUBLE]) AS value FROM l) GROUP BY run_kind, mode, metric")
def metric_means(spark, sf):
    runs = evaluate.latest_runs(_runs(spark, sf)).withColumn("metrics", F.create_map(F.lit("recall"), "recall", F.lit("tokens"), F.col("tokens").cast("double")))
    return evaluate.metric_means(runs).withColumn("mean", F.round("mean", 6))


@query("""
    WITH l AS (SELECT documents.source AS case_key, doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT case_key, coalesce(list(doc_id) FILTER (quality = 1), []) AS e, coalesce(list(doc_id) FILTER (doc_id % 3 = 0), []) AS c, coalesce(sum(n_chars) FILTER (doc_id % 3 = 0), 0)::BIGINT AS b FROM l GROUP BY case_key),
    t AS (SELECT count(*) AS n, sum(n_chars)::BIGINT AS b FROM documents)
    SELECT case_key, len(list_intersect(e, c)) AS hits, len(e) - len(list_intersect(e, c)) AS missing, len(c) - len(list_intersect(e, c)) AS unexpected,
           round(CASE WHEN len(c) > 0 THEN len(list_intersect(e, c)) / len(c) ELSE 0.0 END, 6) AS precision, round(CASE WHEN len(e) > 0 THEN len(list_intersect(e, c)) / len(e) ELSE 1.0 END, 6) AS recall,
           round(1 - len(c) / t.n, 6) AS candidate_reduction, CAST(ceil(s.b / 4.0) AS BIGINT) AS context_tokens, round(1 - ceil(s.b / 4.0) / ceil(t.b / 4.0), 6) AS token_reduction
    FROM s, t
""")
def retrieval_metrics(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("expected")).distinct()
    rows = d.join(good, "doc_id", "left").select(F.col("source").alias("case_key"), F.col("doc_id").alias("path"), F.coalesce("expected", F.lit(False)).alias("expected"), (F.col("doc_id") % 3 == 0).alias("candidate"), F.col("n_chars").alias("size"))
    totals = d.agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("b")).first()
    out = evaluate.retrieval_counts(rows, F.lit(totals.n), F.lit(totals.b))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "candidate_reduction", "token_reduction")})


@query(_LATEST + """, a AS (SELECT case_key, tokens, recall, success FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY seq) AS q FROM l) WHERE q = 1),
    b AS (SELECT case_key, tokens, recall, success FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY seq DESC) AS q FROM l) WHERE q = 1),
    j AS (SELECT a.tokens AS before, b.tokens AS after, a.recall AS ra, b.recall AS rb, coalesce(a.recall >= 0.95 AND b.recall >= 0.95 AND a.success IS NOT DISTINCT FROM true AND b.success IS NOT DISTINCT FROM true, false) AS ok FROM a JOIN b USING (case_key))
    SELECT count(*) AS pairs, count(*) FILTER (ok) AS eligible, round(CASE WHEN sum(before) FILTER (ok) > 0 THEN 1 - sum(after) FILTER (ok) / sum(before) FILTER (ok) END, 6)::DOUBLE AS reduction, round(avg(ra), 6) AS recall_before, round(avg(rb), 6) AS recall_after FROM j""")
def suite_compare_gated(spark, sf):
    runs = evaluate.latest_runs(_runs(spark, sf)).select("case_key", "tokens", "recall", "success", "seq")
    up, down = (F.row_number().over(Window.partitionBy("case_key").orderBy(o)) for o in (F.asc("seq"), F.desc("seq")))
    both = runs.withColumn("u", up).withColumn("d", down)
    tagged = both.filter("u = 1").withColumn("mode", F.lit("first")).unionByName(both.filter("d = 1").withColumn("mode", F.lit("last")))
    return evaluate.compare(tagged, "first", "last", observed=True).withColumns({c: F.round(c, 6) for c in ("reduction", "recall_before", "recall_after")})


@query(_TOUCH + """, f AS (SELECT task, list_sort(list(DISTINCT path)) AS touched, list_sort(coalesce(list(DISTINCT path) FILTER (relation = 'read'), [])) AS reads FROM t GROUP BY task)
    SELECT task, len(touched) AS touched, len(reads) AS reads, round(len(list_intersect(touched, ['f1', 'f2'])) / 2, 6) AS recall, round(CASE WHEN len(reads) > 0 THEN (len(reads) - len(list_intersect(reads, ['f1', 'f2']))) / len(reads) END, 6) AS irrelevant_reads FROM f""")
def observed_run_metrics(spark, sf):
    t = _touches(spark, sf).groupBy("task").agg(F.collect_set("path").alias("touched"), F.collect_set(F.when(F.col("relation") == "read", F.col("path"))).alias("reads"))
    expected = F.array(F.lit("f1"), F.lit("f2"))
    return t.select("task", F.size("touched").cast("long").alias("touched"), F.size("reads").cast("long").alias("reads"), F.round(F.size(F.array_intersect("touched", expected)) / 2, 6).alias("recall"), F.round(F.when(F.size("reads") > 0, F.size(F.array_except("reads", expected)) / F.size("reads")), 6).alias("irrelevant_reads"))


@query("SELECT user_id AS session, event_id AS call, result FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS result, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) WHERE event_type = 'click' AND next = 'view'")
def call_result_pairs(spark, sf):
    w = Window.partitionBy("session").orderBy("seq")
    e = log(spark, sf).withColumn("result", F.lead("seq").over(w)).withColumn("next", F.lead("event_type").over(w))
    return e.filter("event_type = 'click' AND next = 'view'").select("session", F.col("seq").alias("call"), "result")


# --- Streaming ----------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM events")
def stream_replay_dedup(spark, sf):
    """Events sent twice through a file stream with a ledger in foreachBatch: each is applied once."""
    from ..streaming.replay import replay_table

    return replay_table(spark, f"{sf.rstrip('/')}/events.parquet", ["event_id", "user_id", "event_type"], key="event_id", times=2)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf):
    """Tumbling windows with a watermark over the event stream."""
    from ..streaming.replay import windowed_counts

    return windowed_counts(spark, f"{sf.rstrip('/')}/events.parquet")


@query(_ACTIVE + "SELECT seq, session, active_task FROM a")
def stream_asof_tws(spark, sf):
    """The as-of rule as keyed state of a stream, equal to the batch form."""
    from ..streaming.replay import streamed_active_task

    importable(spark)
    return streamed_active_task(spark, f"{sf.rstrip('/')}/events.parquet")
