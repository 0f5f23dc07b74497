"""Queries over the task layer, human corrections, reports and evaluation, on stand-ins derived from the test tables.

In the stand-in log a signup creates a task, an error closes the task that its session started last, every seventh view ends the
session, and other events read, modify or search one of fifty files. Hooks stand for the same events before they are a log.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import layer3, lifecycle, overlay, reports, routing
from ..runtime import importable, stored, table, working_folder
from ..sources import eventlog
from ..streaming import tasks
from .registry import query
from .standins import log

TYPE_SQL = "CASE WHEN event_type = 'signup' THEN 'task_created' WHEN event_type = 'error' THEN 'task_closed' WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'session_end' ELSE 'task_event' END"
KIND_SQL = "CASE event_type WHEN 'click' THEN 'read' WHEN 'purchase' THEN 'modify' WHEN 'view' THEN 'search' END"
LOG_SQL = f"""
    raw AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session, ts AS created_at, {TYPE_SQL} AS t, {KIND_SQL} AS kind, 'src/f' || (event_id % 50) || '.py' AS path, 'c' || (event_id % 10) AS concept FROM events),
    st AS (SELECT *, last_value(CASE WHEN t = 'task_created' THEN seq END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq) AS started FROM raw),
    ok AS (SELECT *, CASE WHEN t IN ('task_created', 'task_closed') THEN started END AS task FROM st WHERE NOT (t = 'task_closed' AND started IS NULL)),
    ef AS (SELECT *, CASE WHEN t = 'task_created' THEN task WHEN t IN ('task_closed', 'session_end') THEN -1 END AS effect FROM ok),
    up AS (SELECT *, last_value(effect IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq) AS a FROM ef),
    act AS (SELECT *, CASE WHEN a >= 0 THEN a END AS active, CASE WHEN lag(a) OVER (PARTITION BY session ORDER BY seq) >= 0 THEN lag(a) OVER (PARTITION BY session ORDER BY seq) END AS before FROM up),
    closes AS (SELECT task, seq, created_at, 'failed' AS status, concept FROM act WHERE t = 'task_closed'
               UNION ALL SELECT before, seq, created_at, 'interrupted', NULL FROM act WHERE t = 'session_end' AND before IS NOT NULL),
    last AS (SELECT task, arg_max(status, seq) AS status, arg_max(created_at, seq) AS closed_at, max(seq) AS seq FROM closes GROUP BY task)
"""


def typed_log(spark, sf):
    """The stand-in log with the columns of ``layer3.typed``."""
    e = log(spark, sf).withColumn("view_end", (F.col("event_type") == "view") & (F.col("seq") % 7 == 0))
    kind = F.when(F.col("event_type") == "click", "read").when(F.col("event_type") == "purchase", "modify").when(F.col("event_type") == "view", "search")
    of = F.when(F.col("event_type") == "signup", "task_created").when(F.col("event_type") == "error", "task_closed").when(F.col("view_end"), "session_end").otherwise("task_event")
    text = lambda x: F.lit(x).cast("string")
    concept = F.concat(F.lit("c"), F.col("seq") % 10)
    return e.select(
        "seq", F.col("seq").cast("string").alias("event_id"), of.alias("event_type"), "created_at", F.lit("p").alias("project_id"), text(None).alias("error"), F.lit("a").alias("agent"), F.col("session").cast("string").alias("session"), F.col("task").cast("string").alias("task"),
        F.concat(F.lit("task "), F.col("seq")).alias("title"), F.lit("").alias("prompt"), F.lit("failed").alias("status"), F.lit("").alias("summary"), kind.alias("kind"), text(None).alias("tool"), F.lit("{}").alias("data"),
        F.array(F.concat(F.lit("src/f"), F.col("seq") % 50, F.lit(".py"))).alias("paths"), F.when(of == "task_closed", F.array(F.struct(concept.alias("key"), concept.alias("label")))).alias("affected"),
    )


def replayed(spark, sf):
    nothing = spark.createDataFrame([], "project_id string, key string")
    return layer3.replay(typed_log(spark, sf), nothing, nothing)


@query(f"""
    WITH {LOG_SQL} SELECT CAST(o.seq AS VARCHAR) AS task, coalesce(status, 'running') AS status, o.created_at, closed_at
    FROM (SELECT * FROM ok WHERE t = 'task_created') o LEFT JOIN last ON last.task = o.seq
""")
def l3_tasks(spark, sf):
    return replayed(spark, sf)["tasks"].select("task", "status", "created_at", "closed_at")


@query(f"""
    WITH {LOG_SQL} SELECT session, CAST(active AS VARCHAR) AS task, seq, kind, path FROM act WHERE t = 'task_event'
""")
def l3_events(spark, sf):
    return replayed(spark, sf)["events"].select("session", "task", "seq", "kind", "path")


@query(f"""
    WITH {LOG_SQL}, e AS (SELECT active AS task, CASE kind WHEN 'read' THEN 'read' WHEN 'modify' THEN 'modified' ELSE 'searched' END AS relation, path, seq, created_at FROM act WHERE t = 'task_event' AND active IS NOT NULL)
    SELECT 'node_' || sha1('p' || chr(31) || '3' || chr(31) || 'task' || chr(31) || task) AS source_id, relation, 'node_' || sha1('p' || chr(31) || '1' || chr(31) || 'file' || chr(31) || path) AS target_id, count(*) AS n, arg_max(created_at, seq) AS last_seen_at
    FROM e GROUP BY task, relation, path
""")
def l3_file_edges(spark, sf):
    e = replayed(spark, sf)["edges"].filter("relation <> 'affects'")
    return e.select("source_id", "relation", "target_id", F.get_json_object("data", "$.count").cast("long").alias("n"), F.get_json_object("data", "$.last_seen_at").cast("timestamp_ntz").alias("last_seen_at"))


@query(f"""
    WITH {LOG_SQL}, f AS (SELECT c.task, c.concept FROM closes c JOIN last USING (task, seq) WHERE concept IS NOT NULL)
    SELECT 'node_' || sha1('p' || chr(31) || '3' || chr(31) || 'task' || chr(31) || task) AS source_id, 'node_' || sha1('p' || chr(31) || '2' || chr(31) || 'concept' || chr(31) || concept) AS target_id FROM f
""")
def l3_affects(spark, sf):
    return replayed(spark, sf)["edges"].filter("relation = 'affects'").select("source_id", "target_id")


@query(f"""
    WITH {LOG_SQL}, n AS (SELECT 'task' AS kind, CAST(seq AS VARCHAR) AS key FROM ok WHERE t = 'task_created'
    UNION ALL SELECT DISTINCT 'file', path FROM act WHERE t = 'task_event' AND active IS NOT NULL
    UNION ALL SELECT DISTINCT 'concept', c.concept FROM closes c JOIN last USING (task, seq) WHERE concept IS NOT NULL) SELECT kind, count(*) AS n, min(key) AS least, max(key) AS most FROM n GROUP BY kind
""")
def l3_nodes(spark, sf):
    return replayed(spark, sf)["nodes"].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))


@query(f"""
    WITH {LOG_SQL} SELECT (SELECT count(*) FROM raw) AS total, (SELECT count(*) FROM ok) AS applied, (SELECT count(*) FROM raw) - (SELECT count(*) FROM ok) AS skipped, CAST(0 AS BIGINT) AS invalid, CAST(1 AS BIGINT) AS projects
""")
def replay_report(spark, sf):
    return replayed(spark, sf)["report"]


STATE_SQL = """
    touched AS (SELECT active AS task, count(DISTINCT (kind, path)) AS edges, count(*) AS touches, max(seq) AS last_touch FROM act WHERE t = 'task_event' AND active IS NOT NULL GROUP BY active),
    affected AS (SELECT c.task, count(*) AS concepts FROM closes c JOIN last USING (task, seq) WHERE concept IS NOT NULL GROUP BY c.task)
    SELECT CAST(o.seq AS VARCHAR) AS task, coalesce(status, 'running') AS status, o.created_at, closed_at, coalesce(edges, 0) AS edges, CAST(coalesce(touches, 0) AS BIGINT) AS touches, coalesce(concepts, 0) AS concepts
    FROM (SELECT * FROM ok WHERE t = 'task_created') o LEFT JOIN last ON last.task = o.seq LEFT JOIN touched ON touched.task = o.seq LEFT JOIN affected ON affected.task = o.seq
"""


def task_states(got):
    """Each task with its state and what its edges add up to."""
    key = S.stable_id("node_", F.col("project_id"), F.lit("3"), F.lit("task"), F.col("task"))
    affects = F.col("relation") == "affects"
    count = F.get_json_object("data", "$.count").cast("long")
    sums = got["edges"].groupBy("source_id").agg(F.count_if(~affects).alias("edges"), F.sum(F.when(~affects, count)).alias("touches"), F.count_if(affects).alias("concepts"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return got["tasks"].withColumn("source_id", key).join(sums, "source_id", "left").select("task", "status", "created_at", "closed_at", zero("edges"), zero("touches"), zero("concepts"))


@query(f"WITH {LOG_SQL}, {STATE_SQL}")
def l3_replay_in_steps(spark, sf):
    """The log in four pieces, each of which brings the last lines of the piece before again; pieces are compacted on the way."""
    lines = typed_log(spark, sf)
    cuts = lines.agg(F.percentile_approx("seq", [0.25, 0.5, 0.75])).first()[0]
    state = layer3.TaskState(spark, working_folder(spark, "task-state"))
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        piece = lines if low is None else lines.filter(F.col("seq") > low - 100)
        state.fold(piece if high is None else piece.filter(F.col("seq") <= high))
        if k == 1:
            state.compact()
    nothing = spark.createDataFrame([], "project_id string, key string")
    return task_states(state.tables(nothing, nothing))


@query(f"WITH {LOG_SQL}, {STATE_SQL}")
def stream_l3(spark, sf):
    """The log as a stream of files, each with every fourth line, so that the lines of all sessions arrive out of order."""
    lines = typed_log(spark, sf)
    base = working_folder(spark, "task-stream")
    last = lines.agg(F.max("seq")).first()[0] or 0
    lines.withColumn("_file", F.col("seq") % 4).repartition("_file").write.partitionBy("_file").parquet(f"{base}/log")
    tasks.flush_line(lines, 3 * last + 10).withColumn("_file", F.lit(9)).write.mode("append").partitionBy("_file").parquet(f"{base}/log")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/log")
    importable(spark)
    state = layer3.TaskState(spark, f"{base}/state")
    tasks.stream_into(stream, state, f"{base}/offsets", last + 1).awaitTermination()
    nothing = spark.createDataFrame([], "project_id string, key string")
    return task_states(state.tables(nothing, nothing))


@query(f"WITH {LOG_SQL}, {STATE_SQL}")
def backfill_round_trip(spark, sf):
    """State to log to state: the lines that the state implies are put in order, read and replayed."""
    # Both replays keep their lines and partials in tables; a plan that derives them anew for every reader shuffles the log as often.
    first, second = (layer3.TaskState(spark, working_folder(spark, "task-state")) for _ in range(2))
    first.fold(typed_log(spark, sf).withColumn("session", F.concat(F.lit("a:"), "session")))
    lines = eventlog.in_order(layer3.backfill(layer3.merged(first.partials())), layer3.BACKFILL_ORDER)
    second.fold(stored(layer3.typed(eventlog.parsed(lines)), "typed"), strict=True)
    nothing = spark.createDataFrame([], "project_id string, key string")
    got = task_states(second.tables(nothing, nothing))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "closed_at")})


@query("""
    SELECT CAST(user_id AS VARCHAR) AS session, max(CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN ts END) AS ended_at FROM events WHERE event_type = 'view' AND event_id % 7 = 0 GROUP BY user_id
""")
def session_end_fold(spark, sf):
    return replayed(spark, sf)["sessions"].select("session", "ended_at")


HOOK_SQL = "CASE WHEN event_type = 'signup' THEN 'UserPromptSubmit' WHEN event_type = 'error' THEN 'Stop' WHEN event_type = 'click' THEN 'PostToolUse' WHEN event_type = 'purchase' THEN 'PostToolUseFailure' WHEN event_id % 7 = 0 THEN 'SessionEnd' WHEN event_id % 7 = 1 THEN 'Notice' ELSE 'SessionStart' END"


def hooks(spark, sf):
    e = table(spark, sf, "events")
    event = (
        F.when(F.col("event_type") == "signup", "UserPromptSubmit").when(F.col("event_type") == "error", "Stop").when(F.col("event_type") == "click", "PostToolUse").when(F.col("event_type") == "purchase", "PostToolUseFailure")
        .when(F.col("event_id") % 7 == 0, "SessionEnd").when(F.col("event_id") % 7 == 1, "Notice").otherwise("SessionStart")
    )
    read = F.col("event_type") == "click"
    file = F.concat(F.lit("src/f"), F.col("event_id") % 50, F.lit(".py"))
    spelt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/home/u/proj/"), file)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("./x/../"), file)).otherwise(F.concat(F.lit("/home/u/project/"), file))
    call = F.struct(F.when(read, spelt).alias("file_path"), F.when(~read, F.concat(F.lit("cd x && pytest -q ./"), file, F.lit(" '*.py'"))).alias("command"))
    payload = F.to_json(F.struct(event.alias("hook_event_name"), F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("task "), F.col("event_id"), F.lit("\nmore")).alias("prompt"), F.when(read, "Read").otherwise("Bash").alias("tool_name"), call.alias("tool_input"), F.lit("failed").alias("task_status")))
    return e.select(F.col("event_id").alias("seq"), F.lit("p").alias("project_id"), F.lit("a").alias("agent"), F.col("ts").alias("created_at"), payload.alias("payload"))


@query(f"""
    WITH h AS (SELECT event_id AS seq, 'a:' || user_id AS session, event_type, {HOOK_SQL} AS e, 'src/f' || (event_id % 50) || '.py' AS file FROM events),
    x AS (SELECT *, last_value(CASE WHEN e = 'UserPromptSubmit' THEN seq WHEN e IN ('Stop', 'SessionEnd') THEN -1 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM h),
    known AS (SELECT DISTINCT 'src/f' || p_size || '.py' AS file FROM part),
    out AS (
        SELECT seq, session, 0 AS step, 'session_upsert' AS event_type, NULL AS kind, NULL AS status, NULL AS title, '' AS paths FROM x WHERE e IN ('SessionStart', 'UserPromptSubmit')
        UNION ALL SELECT seq, session, 1, 'task_closed', NULL, 'interrupted', NULL, '' FROM x WHERE e = 'UserPromptSubmit' AND r >= 0
        UNION ALL SELECT seq, session, 2, 'task_created', NULL, NULL, 'task ' || seq, '' FROM x WHERE e = 'UserPromptSubmit'
        UNION ALL SELECT seq, session, 3, 'task_event', 'prompt', NULL, NULL, '' FROM x WHERE e = 'UserPromptSubmit'
        UNION ALL SELECT seq, session, 0, 'task_event', 'read', NULL, NULL, CASE WHEN seq % 3 < 2 THEN file ELSE '' END FROM x WHERE e = 'PostToolUse'
        UNION ALL SELECT seq, session, 0, 'task_event', 'test_failed', NULL, NULL, CASE WHEN file IN (SELECT file FROM known) THEN file ELSE '' END FROM x WHERE e = 'PostToolUseFailure'
        UNION ALL SELECT seq, session, 0, 'task_event', 'result', NULL, NULL, '' FROM x WHERE e = 'Stop' AND r >= 0
        UNION ALL SELECT seq, session, 1, 'task_closed', NULL, 'failed', NULL, '' FROM x WHERE e = 'Stop' AND r >= 0
        UNION ALL SELECT seq, session, 0, 'session_end', NULL, NULL, NULL, '' FROM x WHERE e = 'SessionEnd'
        UNION ALL SELECT seq, session, 0, 'task_event', 'Notice', NULL, NULL, '' FROM x WHERE e = 'Notice')
    SELECT * FROM out
""")
def lifecycle_ingest(spark, sf):
    importable(spark)
    known = table(spark, sf, "part").select(F.lit("p").alias("project_id"), F.concat(F.lit("src/f"), "p_size", F.lit(".py")).alias("path")).distinct()
    projects = spark.createDataFrame([("p", "/home/u/proj/")], "project_id string, root string")
    return lifecycle.ingest(hooks(spark, sf), known, projects).select("seq", "session", "step", "event_type", "kind", "status", "title", F.array_join("paths", ",").alias("paths"))


@query("""
    WITH c AS (SELECT conv_id AS session, turn - turn % 2 AS call_id, turn AS seq, CASE WHEN turn % 2 = 0 THEN 'call' ELSE 'result' END AS role, text AS value FROM conversations),
    a AS (SELECT session, call_id, min(seq) AS asked_seq, arg_min(value, seq) AS asked FROM c WHERE role = 'call' GROUP BY ALL),
    b AS (SELECT session, call_id, min(seq) AS answer_seq, arg_min(value, seq) AS answer FROM c WHERE role = 'result' GROUP BY ALL)
    SELECT session, call_id, asked_seq, asked, answer_seq, answer FROM a LEFT JOIN b USING (session, call_id)
""")
def call_pairs_by_id(spark, sf):
    turn = F.col("turn")
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), (turn - turn % 2).alias("call_id"), turn.alias("seq"), F.when(turn % 2 == 0, "call").otherwise("result").alias("role"), F.col("text").alias("value"))
    return lifecycle.pair_calls(c).select("session", "call_id", "asked_seq", "asked", "answer_seq", "answer")


@query(f"""
    WITH {LOG_SQL}, b AS (
        SELECT 0 AS phase, session, min(created_at) AS created_at, NULL AS task, NULL AS kind FROM raw GROUP BY session
        UNION ALL SELECT 1, session, created_at, CAST(seq AS VARCHAR), NULL FROM ok WHERE t = 'task_created'
        UNION ALL SELECT 2, session, created_at, CAST(active AS VARCHAR), kind FROM act WHERE t = 'task_event'
        UNION ALL SELECT 3, o.session, l.closed_at, CAST(o.seq AS VARCHAR), l.status FROM ok o JOIN last l ON l.task = o.seq WHERE o.t = 'task_created')
    SELECT phase, session, created_at, task, kind FROM b
""")
def backfill_envelopes(spark, sf):
    got = replayed(spark, sf)
    e = typed_log(spark, sf)
    sessions = e.groupBy("project_id", "session").agg(F.min("created_at").alias("created_at")).withColumn("ended_at", F.lit(None).cast("timestamp_ntz"))
    out = lifecycle.backfill(sessions, got["tasks"], got["events"], spark.createDataFrame([], "event_id string"))
    return out.select("phase", "session", "created_at", "task", "kind")


# --- Corrections ---------------------------------------------------------------------------------------------------


def _corrections(spark, sf, actions):
    a = F.array(*[F.lit(x) for x in actions])
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("seq"), F.element_at(a, (F.col("event_id") % len(actions) + 1).cast("int")).alias("action"), F.concat(F.lit("c"), F.col("user_id") % 40).alias("subject_key"), F.lit("").alias("relation"), F.lit("").alias("object_key"), F.concat("event_type", F.lit(" "), F.col("event_id") % 3).alias("value"))


_PART_OF_ACTIONS = ["rename_concept", "add_alias", "accept_concept", "reject_concept", "create_concept", "remove"]
_SLOT_SQL = """
    l AS (SELECT event_id AS seq, [{actions}][1 + event_id % 6] AS action, 'c' || (user_id % 40) AS key, event_type || ' ' || (event_id % 3) AS value FROM events),
    k AS (SELECT *, CASE WHEN action IN ('accept_concept', 'reject_concept') THEN 'decision' WHEN action = 'add_alias' THEN 'add_alias ' || value ELSE action END AS slot FROM l WHERE action <> 'remove'),
    s AS (SELECT key, slot, arg_max(action, seq) AS action, arg_max(value, seq) AS value, CASE WHEN slot LIKE 'add_alias%' THEN min(seq) ELSE max(seq) END AS place FROM k GROUP BY key, slot)
""".format(actions=", ".join(f"'{a}'" for a in _PART_OF_ACTIONS))


@query(f"""
    WITH {_SLOT_SQL}, c AS (SELECT 'c' || p_partkey AS key, p_name AS label FROM part),
    n AS (SELECT key, value AS made FROM s WHERE action = 'create_concept'), r AS (SELECT key, value AS name FROM s WHERE action = 'rename_concept'),
    a AS (SELECT key, string_agg(value, ',' ORDER BY place) AS aliases FROM s WHERE slot LIKE 'add_alias%' GROUP BY key), d AS (SELECT key, action AS decision FROM s WHERE slot = 'decision')
    SELECT key, coalesce(r.name, made, label) AS label, CASE WHEN decision = 'reject_concept' THEN false ELSE true END AS active, coalesce(a.aliases, '') AS aliases,
           CASE WHEN made IS NULL AND name IS NULL AND a.aliases IS NULL AND decision IS NULL THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence
    FROM c FULL JOIN n USING (key) LEFT JOIN r USING (key) LEFT JOIN a USING (key) LEFT JOIN d USING (key)
""")
def overlay_concepts(spark, sf):
    """Create, rename, alias, accept and reject; the removes of this stand-in name slots that nothing holds."""
    standing = overlay.last_per_slot(_corrections(spark, sf, _PART_OF_ACTIONS))
    concepts = table(spark, sf, "part").select(F.concat(F.lit("c"), "p_partkey").alias("key"), F.col("p_name").alias("label"), F.lit(True).alias("active"), F.array().cast("array<string>").alias("aliases"), F.lit(0.7).alias("confidence"), F.lit("semantic-heuristic").alias("source"))
    merged = spark.createDataFrame([], "old string, new string")
    return overlay.apply_concepts(concepts, standing, merged).select("key", "label", "active", F.array_join("aliases", ",").alias("aliases"), "confidence")


@query(f"""
    WITH l AS (SELECT [{", ".join(f"'{a}'" for a in [*fixed.OVERLAY_ACTIONS, "other"])}][1 + event_id % 12] AS action, CASE WHEN user_id % 9 = 0 THEN ' & ' ELSE ' C ' || (user_id % 5) || ' & Pay!' END AS s0, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'uses' END AS r,
                      CASE WHEN user_id % 4 = 0 THEN '' ELSE './c ' || (event_id % 5) || '--Pay' END AS o0, CASE WHEN event_type = 'click' THEN ' ' ELSE event_type END AS v FROM events),
    n AS (SELECT *, coalesce(nullif(trim(regexp_replace(lower(s0), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug_s, coalesce(nullif(trim(regexp_replace(lower(o0), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug_o FROM l),
    k AS (SELECT action, r, v, CASE WHEN action = 'other' THEN trim(s0) ELSE slug_s END AS s, CASE WHEN action = 'merge_concept' OR action LIKE '%\\_edge' ESCAPE '\\' THEN slug_o WHEN action LIKE '%map\\_file' ESCAPE '\\' THEN ltrim(o0, './') ELSE o0 END AS o FROM n),
    e AS (SELECT action, s AS subject_key, o AS object_key, CASE WHEN action = 'other' THEN 'unknown action' WHEN s = '' THEN 'no subject' WHEN action IN ('create_concept', 'rename_concept', 'add_alias') AND trim(v) = '' THEN 'no value'
                 WHEN action = 'merge_concept' AND (o = '' OR o = s) THEN 'no other concept' WHEN action IN ('add_edge', 'accept_edge', 'reject_edge') AND (r = '' OR o = '') THEN 'no relation or concept' WHEN action IN ('map_file', 'unmap_file') AND o = '' THEN 'no file' END AS error FROM k)
    SELECT action, subject_key, object_key, coalesce(error, '') AS error, count(*) AS n FROM e GROUP BY ALL
""")
def overlay_checked(spark, sf):
    e = table(spark, sf, "events")
    actions = F.array(*[F.lit(x) for x in [*fixed.OVERLAY_ACTIONS, "other"]])
    raw = e.select(
        F.element_at(actions, (F.col("event_id") % 12 + 1).cast("int")).alias("action"), F.when(F.col("user_id") % 9 == 0, " & ").otherwise(F.concat(F.lit(" C "), F.col("user_id") % 5, F.lit(" & Pay!"))).alias("subject_key"), F.when(F.col("event_id") % 5 == 0, "").otherwise("uses").alias("relation"),
        F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("./c "), F.col("event_id") % 5, F.lit("--Pay"))).alias("object_key"), F.when(F.col("event_type") == "click", " ").otherwise(F.col("event_type")).alias("value"),
    )
    importable(spark)
    return overlay.checked(raw).groupBy("action", "subject_key", "object_key", F.coalesce("error", F.lit("")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    WITH c AS (SELECT DISTINCT p_brand AS key FROM part), e AS (SELECT DISTINCT p_brand AS source, 'Brand#' || (1 + p_partkey % 25) AS target FROM part WHERE p_brand <> 'Brand#' || (1 + p_partkey % 25)),
    l AS (SELECT event_id AS seq, ['add_edge', 'accept_edge', 'reject_edge'][1 + event_id % 3] AS action, 'Brand#' || (1 + user_id % 30) AS s, 'Brand#' || (1 + event_id % 28) AS o FROM events),
    st AS (SELECT s, o, arg_max(action, seq) AS action FROM l GROUP BY s, o),
    yes AS (SELECT s, o, action FROM st WHERE action <> 'reject_edge' AND s IN (SELECT key FROM c) AND o IN (SELECT key FROM c)),
    kept AS (SELECT source, target FROM e WHERE (source, target) NOT IN (SELECT (s, o) FROM st WHERE action = 'reject_edge') AND (source, target) NOT IN (SELECT (s, o) FROM yes))
    SELECT source, target, false AS human, NULL AS review_decision FROM kept UNION ALL SELECT s, o, true, CASE WHEN action = 'accept_edge' THEN 'accepted' ELSE 'manual' END FROM yes
""")
def overlay_edges(spark, sf):
    """Added, accepted and rejected edges through the whole application of corrections."""
    part = table(spark, sf, "part")
    concepts = part.select(F.col("p_brand").alias("key")).distinct().withColumns({"label": F.col("key"), "active": F.lit(True), "aliases": F.array().cast("array<string>"), "confidence": F.lit(0.7), "source": F.lit("semantic-heuristic")})
    target = F.concat(F.lit("Brand#"), F.col("p_partkey") % 25 + 1)
    edges = part.select(F.lit(2).alias("layer"), F.col("p_brand").alias("source"), F.lit("uses").alias("relation"), target.alias("target"), F.lit("concept").alias("target_kind"), F.lit("{}").alias("data")).filter("source <> target").distinct()
    actions = F.array(*[F.lit(x) for x in overlay.EDGE_ACTIONS])
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.element_at(actions, (F.col("event_id") % 3 + 1).cast("int")).alias("action"), F.concat(F.lit("Brand#"), F.col("user_id") % 30 + 1).alias("subject_key"), F.lit("uses").alias("relation"), F.concat(F.lit("Brand#"), F.col("event_id") % 28 + 1).alias("object_key"), F.lit("").alias("value"))
    _, out = overlay.apply_all(concepts, edges, spark.createDataFrame([], "path string"), overlay.last_per_slot(e))
    return out.select("source", "target", "human", "review_decision")


# --- Reports -------------------------------------------------------------------------------------------------------


def _graph(spark, sf):
    """Parts are files of the concept of their brand, line items of one order refer to each other, orders are tasks on their parts."""
    part, li, orders = (table(spark, sf, t) for t in ("part", "lineitem", "orders"))
    f, c, t = (lambda x, p=p: F.concat(F.lit(p), x) for p in ("f", "c", "t"))
    node = lambda df, i, layer, kind, key, label: df.select(i.alias("id"), F.lit("p").alias("project_id"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"), F.lit(True).alias("active"))
    path = F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), "p_partkey", F.lit(".py"))
    nodes = (
        node(part, f(F.col("p_partkey")), 1, "file", path, F.col("p_name")).unionByName(node(part.select("p_brand").distinct(), c(F.col("p_brand")), 2, "concept", F.col("p_brand"), F.col("p_brand")))
        .unionByName(node(orders, t(F.col("o_orderkey")), 3, "task", F.col("o_orderkey").cast("string"), F.col("o_orderpriority")))
    )
    edge = lambda df, layer, a, relation, b: df.select(F.lit("p").alias("project_id"), F.lit(layer).alias("layer"), a.alias("source_id"), F.lit(relation).alias("relation"), b.alias("target_id"))
    a = li.select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("i"))
    b = li.select("l_orderkey", F.col("l_partkey").alias("b"), (F.col("l_linenumber") - 1).alias("i"))
    edges = (
        edge(a.join(b, ["l_orderkey", "i"]).filter("a <> b").select("a", "b").distinct(), 1, f(F.col("a")), "imports", f(F.col("b"))).unionByName(edge(part, 2, c(F.col("p_brand")), "implemented_by", f(F.col("p_partkey"))))
        .unionByName(edge(li.select("l_orderkey", "l_partkey").distinct(), 3, t(F.col("l_orderkey")), "modified", f(F.col("l_partkey"))))
    )
    tasks = orders.select(F.col("o_orderkey").cast("string").alias("task"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    return nodes, edges, tasks


_GRAPH_SQL = """
    ed AS (SELECT DISTINCT 1 AS layer, 'f' || a.l_partkey AS s, 'f' || b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber - 1 WHERE a.l_partkey <> b.l_partkey
           UNION ALL SELECT 2, 'c' || p_brand, 'f' || p_partkey FROM part UNION ALL SELECT DISTINCT 3, 't' || l_orderkey, 'f' || l_partkey FROM lineitem)
"""


@query(f"""
    WITH {_GRAPH_SQL} SELECT 'p' AS project_id, (SELECT count(*) FROM part) AS files, (SELECT count(DISTINCT p_brand) FROM part) AS concepts, (SELECT count(*) FROM orders) AS tasks,
    (SELECT count(*) FROM part) + (SELECT count(DISTINCT p_brand) FROM part) + (SELECT count(*) FROM orders) AS nodes, (SELECT count(*) FROM ed WHERE layer = 1) AS physical_edges, (SELECT count(*) FROM ed WHERE layer = 2) AS semantic_edges
""")
def project_statistics(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    return reports.statistics(nodes, edges)


@query(f"""
    WITH {_GRAPH_SQL}, p AS (SELECT 'f' || p_partkey AS id, 'src/' || lower(p_brand) || '/' || p_partkey || '.py' AS key, p_name AS label, p_brand FROM part), m AS (SELECT * FROM p WHERE id = 'f7')
    SELECT 'file' AS section, '' AS relation, key, label FROM m
    UNION ALL SELECT 'outgoing', 'imports', p.key, p.label FROM ed JOIN p ON t = p.id WHERE layer = 1 AND s = 'f7' UNION ALL SELECT 'incoming', 'imports', p.key, p.label FROM ed JOIN p ON s = p.id WHERE layer = 1 AND t = 'f7'
    UNION ALL SELECT 'concept', '', p_brand, p_brand FROM m
    UNION ALL SELECT * FROM (SELECT 'task', 'modified', CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority FROM ed JOIN orders ON s = 't' || o_orderkey WHERE layer = 3 AND t = 'f7' ORDER BY o_orderdate DESC, k LIMIT 20)
""")
def file_impact_report(spark, sf):
    nodes, edges, tasks = _graph(spark, sf)
    return reports.file_impact(nodes, edges, tasks, "p", "/7.py")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS task, o_orderpriority AS title, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
def task_history(spark, sf):
    return reports.history(_graph(spark, sf)[2])


@query(f"""
    WITH {_GRAPH_SQL}, g AS (SELECT 'f' || p_partkey AS id FROM part WHERE p_size > 25) SELECT layer, count(*) AS n FROM ed WHERE s NOT IN (SELECT id FROM g) AND t NOT IN (SELECT id FROM g) GROUP BY layer
""")
def cascade_delete(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    gone = table(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("f"), "p_partkey").alias("id"))
    return reports.remove_nodes(nodes, edges, gone)[1].groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GRAPH_SQL} SELECT layer, count(*) AS n FROM ed WHERE layer <> 3 GROUP BY layer")
def layer_reset(spark, sf):
    nodes, edges, _ = _graph(spark, sf)
    return reports.reset_layer(nodes.withColumn("data", F.lit("{}")), edges, 3)[1].groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


# --- Evaluation ----------------------------------------------------------------------------------------------------


def _suite(spark, sf):
    """Regions are cases that ask for a brand by name and expect the parts of their sizes; parts are files of the concept of their brand, and each brand depends on the next."""
    part, region = table(spark, sf, "part"), table(spark, sf, "region")
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("_"), "p_partkey", F.lit(".py"))
    files = part.select(path.alias("path"), F.col("p_size").cast("long").alias("size"), "p_brand")
    want = files.groupBy((F.col("size") % 5).alias("r_regionkey")).agg(F.array_sort(F.collect_list("path")).alias("expected"))
    query = F.concat(F.lit("steel Brand#"), 11 + F.col("r_regionkey"), F.lit(" "), F.lower("r_name"), F.lit(" _1"), F.col("r_regionkey"))
    cases = region.join(want, "r_regionkey").select(F.col("r_name").alias("case_key"), query.alias("query"), "expected")
    node = lambda df, layer, kind, key, label, data: df.select(F.concat(F.lit(kind[0]), key).alias("id"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"), data.alias("data"), F.lit(True).alias("active"), F.array().cast("array<string>").alias("aliases"))
    brands = part.select("p_brand").distinct()
    nodes = node(part.withColumn("path", path), 1, "file", F.col("path"), F.col("p_name"), F.concat(F.lit('{"type":"'), "p_type", F.lit('"}'))).unionByName(node(brands, 2, "concept", F.lower("p_brand"), F.col("p_brand"), F.lit("{}")))
    brand = F.concat(F.lit("c"), F.lower("p_brand"))
    after = F.concat(F.lit("cbrand#"), F.substring("p_brand", 7, 9).cast("int") + 1)
    edges = files.select(brand.alias("source_id"), F.lit("implemented_by").alias("relation"), F.concat(F.lit("f"), "path").alias("target_id")).unionByName(brands.select(brand.alias("source_id"), F.lit("depends_on").alias("relation"), after.alias("target_id")))
    return cases, files.select("path", "size"), nodes, edges


_CONTEXT_SQL = r"""
    f AS (SELECT 'src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(replace(p_name, ' ', '_')) || '_' || p_partkey || '.py' AS path, CAST(p_size AS BIGINT) AS size, p_brand, p_name, p_type FROM part),
    w AS (SELECT r_name AS case_key, path FROM region JOIN f ON size % 5 = r_regionkey),
    q AS (SELECT r_name AS case_key, 'steel Brand#' || (11 + r_regionkey) || ' ' || lower(r_name) || ' _1' || r_regionkey AS query FROM region),
    t AS (SELECT case_key, lower(query) AS q, unnest(list_distinct(list_concat([lower(query)], list_transform(regexp_extract_all(query, '[A-Za-z0-9_.\-/]{2,}'), lambda x: lower(x))))) AS term FROM q),
    b AS (SELECT DISTINCT p_brand FROM f),
    n AS (SELECT 'f' || path AS id, 1 AS layer, path AS key, p_name AS label, '{"type":"' || p_type || '"}' AS data FROM f UNION ALL SELECT 'c' || lower(p_brand), 2, lower(p_brand), p_brand, '{}' FROM b),
    ed AS (SELECT 'c' || lower(p_brand) AS s, 'implemented_by' AS relation, 'f' || path AS t FROM f UNION ALL SELECT 'c' || lower(p_brand), 'depends_on', 'cbrand#' || (CAST(substring(p_brand, 7) AS INTEGER) + 1) FROM b),
    p AS (SELECT case_key, q, id, layer, key, label, CASE WHEN lower(label) = term THEN 9 WHEN contains(lower(label), term) THEN 5 ELSE 0 END + CASE WHEN lower(key) = term THEN 6 WHEN contains(lower(key), term) THEN 3 ELSE 0 END + CASE WHEN contains(lower(data), term) THEN 1 ELSE 0 END
                 + CASE WHEN term = q AND contains(lower(label), term) THEN 12 ELSE 0 END + CASE WHEN term = q AND contains(lower(key), term) THEN 8 ELSE 0 END AS part FROM t CROSS JOIN n),
    sc AS (SELECT case_key, id, layer, key, label, CASE layer WHEN 1 THEN 2 ELSE 5 END + sum(part) AS score FROM p GROUP BY case_key, q, id, layer, key, label HAVING sum(part) > 0 OR (layer = 2 AND (contains(q, lower(label)) OR contains(q, key)))),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY score DESC, label, id) AS r FROM sc) WHERE r <= 40),
    cr AS (SELECT case_key, id, 0 AS p, -score AS s FROM best WHERE layer = 2 UNION ALL SELECT case_key, ed.s, 1, -score FROM best JOIN ed ON ed.t = id WHERE layer = 1),
    cg AS (SELECT case_key, id, min((p, s)) AS r FROM cr GROUP BY case_key, id),
    cc AS (SELECT case_key, id FROM (SELECT cg.*, row_number() OVER (PARTITION BY case_key ORDER BY r, label, cg.id) AS x FROM cg JOIN n ON n.id = cg.id AND layer = 2) WHERE x <= 5),
    near AS (SELECT DISTINCT x.case_key, x.id, relation, n.label FROM (SELECT case_key, t AS id, relation FROM ed JOIN cc ON cc.id = s UNION ALL SELECT case_key, s, relation FROM ed JOIN cc ON cc.id = t) x JOIN n ON n.id = x.id AND n.layer = 2 WHERE NOT EXISTS (SELECT 1 FROM cc WHERE cc.case_key = x.case_key AND cc.id = x.id)),
    cl AS (SELECT case_key, id FROM (SELECT case_key, id, row_number() OVER (PARTITION BY case_key ORDER BY min((label, relation)), id) AS x FROM near GROUP BY case_key, id) WHERE x <= 4),
    hop AS (SELECT case_key, path FROM (SELECT cl.case_key, cl.id, f.path, row_number() OVER (PARTITION BY cl.case_key, cl.id ORDER BY f.path) AS x FROM cl JOIN ed ON ed.s = cl.id JOIN f ON 'f' || f.path = ed.t) WHERE x <= 4),
    fl AS (SELECT case_key, path, min(p) AS p FROM (SELECT case_key, key AS path, 0 AS p FROM best WHERE layer = 1 UNION ALL SELECT case_key, f.path, 1 FROM cc JOIN ed ON ed.s = cc.id JOIN f ON 'f' || f.path = ed.t UNION ALL SELECT case_key, path, 2 FROM hop) GROUP BY case_key, path),
    o AS (SELECT case_key, path, p, x FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY p, path) AS x FROM fl) WHERE x <= 12),
    nf AS (SELECT case_key, path FROM (SELECT case_key, path, row_number() OVER (PARTITION BY case_key ORDER BY round(score, 6) DESC, path) AS x FROM (
        SELECT case_key, path, sum(CASE WHEN path = term OR lower(p_name) = term THEN 10.0 WHEN contains(path, term) THEN 4.0 + least(length(term), 10) / 10 WHEN contains(lower(p_name), term) THEN 3.0 ELSE 0.0 END) AS score FROM t CROSS JOIN f GROUP BY case_key, path) WHERE score > 0) WHERE x <= 12)
"""


@query(f"""
    WITH {_CONTEXT_SQL},
    x AS (SELECT r_name AS case_key, 'full-scan' AS mode, path FROM region CROSS JOIN f UNION ALL SELECT case_key, 'routed', path FROM o UNION ALL SELECT case_key, 'filename-search', path FROM nf),
    g AS (SELECT x.case_key, mode, count(*) AS n, count(w.path) AS h, sum(size) AS b FROM x LEFT JOIN w ON w.case_key = x.case_key AND w.path = x.path JOIN f ON f.path = x.path GROUP BY ALL),
    m AS (SELECT case_key, count(*) AS m FROM w GROUP BY case_key)
    SELECT case_key, mode, n AS candidates, h AS hits, m - h AS missing, round(h / n, 9) AS precision, round(h / m, 9) AS recall, CAST(ceil(b / 4) AS BIGINT) AS tokens FROM g JOIN m USING (case_key)
""")
def suite_runs(spark, sf):
    cases, files, nodes, edges = _suite(spark, sf)
    out = reports.run_suite(cases, reports.candidates(cases, nodes, edges), files)
    return out.select("case_key", "mode", "candidates", "hits", "missing", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.col("tokens").cast("long").alias("tokens"))


@query(f"""
    WITH {_CONTEXT_SQL} SELECT case_key, 'files' AS part, path AS item, CAST(p AS BIGINT) AS rank FROM o UNION ALL SELECT case_key, 'filename-search', path, 0 FROM nf UNION ALL SELECT case_key, 'concepts', id, 0 FROM cc
""")
def contexts_of_queries(spark, sf):
    """The context of all cases in one plan: concepts, files with the source that gave them, and files by name."""
    cases, _, nodes, edges = _suite(spark, sf)
    got = routing.contexts(cases, nodes, edges)
    files = nodes.filter("layer = 1").select(F.col("key").alias("path"), "label")
    row = lambda df, part, item, rank: df.select("case_key", F.lit(part).alias("part"), item.alias("item"), rank.cast("long").alias("rank"))
    none = F.lit(0)
    return row(got["files"], "files", F.col("path"), F.col("priority")).unionByName(row(routing.named_files(cases, files), "filename-search", F.col("path"), none)).unionByName(row(got["concepts"], "concepts", F.col("id"), none))


@query("""
    WITH e AS (SELECT user_id AS task, event_type, 'f' || (event_id % 20) AS path FROM events), t AS (SELECT task, path, bool_or(event_type = 'click') AS r FROM e GROUP BY task, path),
    w AS (SELECT DISTINCT user_id AS task, 'f' || (user_id % 25) AS path FROM events WHERE event_type = 'purchase'),
    g AS (SELECT task, count(t.path) AS observed_files, count(*) FILTER (r) AS read_files, count(w.path) AS expected, count(*) FILTER (t.path IS NOT NULL AND w.path IS NOT NULL) AS h, count(*) FILTER (r AND w.path IS NULL) AS l FROM t FULL JOIN w USING (task, path) GROUP BY task)
    SELECT task, observed_files, read_files, expected, CASE WHEN expected > 0 THEN h / expected END AS recall, CASE WHEN expected > 0 THEN l END AS irrelevant_reads, CASE WHEN expected > 0 AND read_files > 0 THEN l / read_files END AS irrelevant_ratio FROM g
""")
def observed_runs(spark, sf):
    e = table(spark, sf, "events")
    events = e.select(F.col("user_id").alias("task"), F.when(F.col("event_type") == "click", "read").otherwise("modify").alias("kind"), F.concat(F.lit("f"), F.col("event_id") % 20).alias("path"))
    want = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("task"), F.concat(F.lit("f"), F.col("user_id") % 25).alias("path"))
    return reports.observed(events, want)


@query("""
    WITH r AS (SELECT user_id % 40 AS case_key, ['retrieval', 'retrieval', 'retrieval', 'observed', 'observed'][1 + event_id % 5] AS run_kind, ['full-scan', 'filename-search', 'routed', 'baseline', 'routed'][1 + event_id % 5] AS mode, value AS tokens,
               CASE WHEN event_id % 11 = 0 THEN 0.9 ELSE 1.0 END AS recall, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 7 <> 0 END AS success, ts, event_id FROM events),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_key, run_kind, mode ORDER BY ts DESC, event_id) AS p FROM r) WHERE p = 1),
    k AS (SELECT * FROM (VALUES ('retrieval', 'full-scan', 'routed'), ('retrieval', 'filename-search', 'routed'), ('observed', 'baseline', 'routed')) AS v(run_kind, baseline, routed)),
    j AS (SELECT k.*, a.tokens AS x, b.tokens AS y, a.recall >= 0.95 AND b.recall >= 0.95 AND (k.run_kind <> 'observed' OR (a.success IS TRUE AND b.success IS TRUE)) AS ok
          FROM k JOIN l a ON a.run_kind = k.run_kind AND a.mode = k.baseline JOIN l b ON b.run_kind = k.run_kind AND b.mode = k.routed AND a.case_key = b.case_key)
    SELECT run_kind, baseline, routed, count(*) AS pairs, count(*) FILTER (ok) AS eligible, round(CASE WHEN sum(x) FILTER (ok) > 0 THEN 1 - sum(y) FILTER (ok) / sum(x) FILTER (ok) END, 6) AS reduction FROM j GROUP BY ALL
""")
def suite_comparisons(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") % 5 + 1).cast("int"))
    runs = e.select(
        (F.col("user_id") % 40).alias("case_key"), pick("retrieval", "retrieval", "retrieval", "observed", "observed").alias("run_kind"), pick("full-scan", "filename-search", "routed", "baseline", "routed").alias("mode"), F.col("value").alias("tokens"),
        F.when(F.col("event_id") % 11 == 0, 0.9).otherwise(1.0).alias("recall"), F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 7 != 0).alias("success"), F.col("ts").alias("created_at"), F.col("event_id").alias("seq"),
    )
    return reports.comparisons(runs).select("run_kind", "baseline", "routed", "pairs", "eligible", F.round("reduction", 6).alias("reduction"))
