"""The task layer from the log: sessions, tasks, events, nodes and edges, as one batch of folds instead of a loop over lines.

``typed`` turns log lines into columns, ``replay`` folds a whole log, ``TaskState`` a log that arrives in pieces. Each table depends
on the log alone, so replaying twice, in pieces, or a log that repeats events, gives the same rows. The order of the log (``seq``)
decides, not its times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S


def typed(lines: DataFrame) -> DataFrame:
    """Columns of lines(seq, event_id, event_type, created_at, project_id, payload, error); broken lines keep their error."""
    p = lambda x: F.get_json_object("payload", x)
    return lines.select(
        "seq", "event_id", "event_type", "created_at", "project_id", "error", p("$.agent").alias("agent"), S.session_key(p("$.agent"), p("$.external_session_id")).alias("session"), p("$.task_id").alias("task"),
        F.coalesce(p("$.title"), F.lit(fixed.UNNAMED)).alias("title"), F.coalesce(p("$.prompt"), F.lit("")).alias("prompt"), F.coalesce(p("$.status"), F.lit("completed")).alias("status"), F.coalesce(p("$.summary"), F.lit("")).alias("summary"),
        p("$.event_type").alias("kind"), p("$.tool_name").alias("tool"), F.coalesce(p("$.data"), F.lit("{}")).alias("data"),
        F.from_json(p("$.paths"), "array<string>").alias("paths"), F.from_json(p("$.affected_concepts"), "array<struct<key:string,label:string>>").alias("affected"),
    )


# --- Folds with mergeable state ------------------------------------------------------------------------------------
#
# What a log leaves behind is a set of partials: for each key of each fold one row that merges with others by minima, maxima
# and sums. A piece of a log gives its own partials; together with those of earlier pieces they are the partials of the whole log.

FOLDS = ("lines", "births", "closes", "sessions", "running", "touches")
LOOKUPS = ("lines", "births", "running")  # what a piece must know of earlier ones; of its lines the ids
BLOCK_ROWS = 1 << 16


def valid(events: DataFrame, project: str | None = None) -> DataFrame:
    """Events without an error, of one project if named, each id once: its first line counts."""
    ok = events.filter("error IS NULL")
    if project is not None:
        ok = ok.filter(F.col("project_id") == project)
    first = F.row_number().over(Window.partitionBy("event_id").orderBy("seq"))
    return ok.withColumn("_n", first).filter("_n = 1").drop("_n")


def applied(events: DataFrame, known: dict[str, DataFrame] | None = None, project: str | None = None) -> DataFrame:
    """Valid events that no earlier piece applied, with the session of their task where they name none; closes of tasks that nobody created before are left out."""
    ok = valid(events, project)
    if known is not None:
        ok = ok.join(known["lines"].select("event_id"), "event_id", "left_anti")
    births = ok.filter("event_type = 'task_created'").select("project_id", "task", F.col("seq").alias("born"), F.col("session").alias("owner"))
    if known is not None:
        births = births.unionByName(known["births"].select("project_id", "task", "born", "owner"))
    first = births.groupBy("project_id", "task").agg(F.min("born").alias("_born"), F.min_by("owner", "born").alias("_owner"))
    out = ok.join(first, ["project_id", "task"], "left").filter((F.col("event_type") != "task_closed") | (F.col("_born") < F.col("seq")))
    return out.withColumn("session", F.coalesce("session", F.when(F.col("_born") < F.col("seq"), F.col("_owner")))).drop("_born", "_owner")


def carried(rows: DataFrame, value: Column, upto: str, before: str | None = None) -> DataFrame:
    """``rows`` with the last non-null ``value`` of their session up to each row, and up to the row before it.

    A session's rows are cut into blocks by seq: each block carries the last value of the blocks before it, so a session of any
    length is many tasks' work.
    """
    cut = rows.withColumn("_block", F.floor(F.col("seq") / BLOCK_ROWS)).withColumn("_value", value)
    ends = cut.filter("_value IS NOT NULL").groupBy("session", "_block").agg(F.max_by("_value", "seq").alias("_end"))
    blocks = cut.select("session", "_block").distinct().join(ends, ["session", "_block"], "left")
    earlier = Window.partitionBy("session").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("session").alias("_s"), F.col("_block").alias("_b"), F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    own = Window.partitionBy("session", "_block").orderBy("seq")
    out = cut.join(blocks, F.col("session").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left")
    last = lambda end: F.coalesce(F.last("_value", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, end)), F.col("_carry"))
    out = out.withColumn(upto, last(0)) if before is None else out.withColumn(upto, last(0)).withColumn(before, last(-1))
    return out.drop("_block", "_value", "_carry", "_s", "_b")


def with_active(done: DataFrame, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Events with ``started``, ``before`` and ``active_task``: the task that their session started last, and its running one before and after each event.

    A creation starts its task; a close clears the running task only if it is the one started last; a session's end clears it.
    """
    none = F.lit(None).cast("string")
    kind = F.col("event_type")
    e = done.withColumns({"_started": none, "_active": none})
    if known is not None:
        held = known["running"].select(F.col("session").alias("_s"), F.col("started").alias("_started"), F.col("active").alias("_active"))
        e = done.join(held, F.col("session") == F.col("_s"), "left").drop("_s")
    e = carried(e, F.when(kind == "task_created", F.col("task")), "_latest").withColumn("started", F.coalesce("_latest", "_started"))
    clears = ((kind == "task_closed") & (F.col("task") == F.col("started"))) | (kind == "session_end")
    effect = F.when(kind == "task_created", F.struct(F.col("task").alias("t"))).when(clears, F.struct(none.alias("t")))
    e = carried(e, effect, "_upto", "_until")
    state = lambda c: F.when(F.col(c).isNotNull(), F.col(c)["t"]).otherwise(F.col("_active"))
    return e.withColumn("before", state("_until")).withColumn("active_task", state("_upto")).drop("_latest", "_started", "_active", "_upto", "_until")


def event_rows(active: DataFrame) -> DataFrame:
    """One row for each path of an event, one with a null path if it names none; the task is the named one, else the running one."""
    e = active.filter("event_type = 'task_event'").withColumn("task", F.coalesce("task", "active_task"))
    paths = F.filter(F.array_distinct(F.coalesce("paths", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return e.select("project_id", "task", "session", "agent", "seq", "created_at", "kind", "tool", "data", F.explode_outer(paths).alias("path"))


def active_lines(events: DataFrame, known: dict[str, DataFrame] | None = None, project: str | None = None) -> DataFrame:
    """The lines of typed ``events`` that apply, with their session's running task, given the ``LOOKUPS`` that earlier pieces of the log left; places (seq) go on from piece to piece."""
    return with_active(applied(events, known, project), known)


def partials(active: DataFrame) -> dict[str, DataFrame]:
    """The partials of the lines of ``active_lines``."""
    keys = ["project_id", "task", "seq", "created_at", "status", "summary", "affected"]
    said = active.filter("event_type = 'task_closed'").select(*keys)
    # The end of a session cuts off the task that still runs in it.
    cut = active.filter("event_type = 'session_end' AND before IS NOT NULL").withColumns({"task": F.col("before"), "status": F.lit("interrupted"), "summary": F.lit("")}).select(*keys)
    touched = event_rows(active).filter("task IS NOT NULL AND path IS NOT NULL")
    relation = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.TASK_EDGE_RELATIONS.items() for x in kv]), F.col("kind"))
    return {
        "lines": active,
        "births": active.filter("event_type = 'task_created'").groupBy("project_id", "task").agg(F.min("seq").alias("born"), F.min_by("session", "seq").alias("owner"), F.min_by(F.struct("title", "prompt", "agent", "session", "created_at"), "seq").alias("first")),
        "closes": said.unionByName(cut).groupBy("project_id", "task").agg(F.max("seq").alias("at"), F.max_by(F.struct("status", "summary", "created_at", "affected"), "seq").alias("last")),
        "sessions": active.filter(F.col("event_type").isin("session_upsert", "session_end")).groupBy("project_id", "session").agg(
            F.min("seq").alias("opened"), F.min_by(F.struct("agent", "created_at"), "seq").alias("first"), F.max("seq").alias("at"), F.max_by(F.struct(F.col("created_at").alias("updated_at"), F.when(F.col("event_type") == "session_end", F.col("created_at")).alias("ended_at")), "seq").alias("last")),
        "running": active.filter("session IS NOT NULL").groupBy("session").agg(F.max("seq").alias("at"), F.max_by(F.struct("started", F.col("active_task").alias("active")), "seq").alias("last")),
        "touches": touched.withColumn("relation", relation).groupBy("project_id", "task", "relation", "path").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("at"), F.max_by("created_at", "seq").alias("last_seen_at")),
    }


def merged(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Partials of several pieces as one row a key; the tables may hold any number of rows for a key."""
    def by(df: DataFrame, *keys: str) -> DataFrame:
        firsts, lasts = [c for c in ("owner", "first") if c in df.columns], [c for c in ("last", "last_seen_at") if c in df.columns]
        born = "opened" if "opened" in df.columns else "born"
        out = [F.min_by(c, born).alias(c) for c in firsts] + [F.max_by(c, "at").alias(c) for c in lasts]
        out += [F.min(c).alias(c) for c in ("born", "opened") if c in df.columns] + [F.max("at").alias("at")] * ("at" in df.columns) + [F.sum("n").alias("n")] * ("n" in df.columns)
        return df.groupBy(*keys).agg(*out)

    task = ("project_id", "task")
    return {
        "lines": state["lines"], "births": by(state["births"], *task), "closes": by(state["closes"], *task), "sessions": by(state["sessions"], "project_id", "session"),
        "running": by(state["running"], "session"), "touches": by(state["touches"], *task, "relation", "path"),
    }


def tables(state: dict[str, DataFrame], file_nodes: DataFrame, concept_nodes: DataFrame) -> dict[str, DataFrame]:
    """sessions, tasks, events, nodes and edges of merged partials.

    file_nodes and concept_nodes(project_id, key) are what the lower layers hold; other files and concepts that the log names
    get placeholder nodes. An ``affects`` edge comes from the last close of a task as the log has it; it is not derived anew.
    """
    status = F.coalesce("last.status", F.lit("running"))
    made = state["births"].join(state["closes"].select("project_id", "task", "last"), ["project_id", "task"], "left").select(
        "project_id", "task", "first.title", "first.prompt", "first.agent", "first.session", "first.created_at", status.alias("status"), F.coalesce("last.summary", F.lit("")).alias("summary"), F.when(status.isin(fixed.TERMINAL_STATUSES), F.col("last.created_at")).alias("closed_at")
    )
    nid = lambda layer, kind, key: S.stable_id("node_", F.col("project_id"), F.lit(str(layer)), F.lit(kind), key)
    touches = state["touches"]
    hit = state["closes"].select("project_id", "task", F.explode("last.affected").alias("a")).filter("trim(a.key) <> ''").groupBy("project_id", "task", F.trim("a.key").alias("key")).agg(F.min("a.label").alias("label"))

    def node(df: DataFrame, layer: int, kind: str, key, label, data, confidence: float, source: str) -> DataFrame:
        return df.select(nid(layer, kind, key).alias("id"), "project_id", F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), key.alias("key"), label.alias("label"), data.alias("data"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))

    new_files = touches.select("project_id", F.col("path").alias("key")).distinct().join(file_nodes.select("project_id", "key"), ["project_id", "key"], "left_anti")
    new_concepts = hit.groupBy("project_id", "key").agg(F.min("label").alias("label")).join(concept_nodes.select("project_id", "key"), ["project_id", "key"], "left_anti")
    task_data = F.to_json(F.struct("status", "agent", "session", "created_at"))
    nodes = (
        node(made, 3, "task", F.col("task"), F.col("title"), task_data, 1.0, "task-events")
        .unionByName(node(new_files, 1, "file", F.col("key"), S.basename(F.col("key")), F.lit('{"placeholder":true}'), 0.5, "task-events"))
        .unionByName(node(new_concepts, 2, "concept", F.col("key"), F.coalesce("label", S.humanize(F.col("key"))), F.lit('{"active":true,"replay_placeholder":true}'), 0.5, "task-event-replay"))
    )
    task_id = nid(3, "task", F.col("task"))
    file_edges = touches.filter("relation IS NOT NULL").select("project_id", task_id.alias("source_id"), "relation", nid(1, "file", F.col("path")).alias("target_id"), F.to_json(F.struct(F.col("n").alias("count"), F.col("last_seen_at").cast("string").alias("last_seen_at"), "path")).alias("data"))
    affects = hit.select("project_id", task_id.alias("source_id"), F.lit("affects").alias("relation"), nid(2, "concept", F.col("key")).alias("target_id"), F.lit("{}").alias("data"))
    edges = file_edges.unionByName(affects).withColumns({"layer": F.lit(3), "confidence": F.lit(1.0), "source": F.lit("task-events")})
    sessions = state["sessions"].select("project_id", "session", "first.agent", "first.created_at", "last.updated_at", "last.ended_at")
    return {"sessions": sessions, "tasks": made, "events": event_rows(state["lines"]), "nodes": nodes, "edges": edges}


def backfill(state: dict[str, DataFrame], log: DataFrame | None = None) -> DataFrame:
    """Log lines (phase, born, task, step, place, event_id, value) that merged partials imply and ``log(event_id)`` lacks; written in the order of ``BACKFILL_ORDER`` they replay to the same tables.

    Sessions come first, then ends of sessions that still run a task, events of no task, each task with its creation, its events
    and its close, and last the other ends. ``value`` is a canonical envelope: keys in their order, no key without a value. Ids follow
    from the keys, so a second backfill of the same state adds nothing.
    """
    agent, external = F.regexp_extract("session", "^([^:]*):", 1), F.regexp_extract("session", "^[^:]*:(.*)$", 1)

    def rows(df: DataFrame, phase: int, step: int, event_type: str, at: Column, born: Column, seq: Column, key: Column, payload: dict[str, Column]) -> DataFrame:
        event_id = S.stable_id("event_", F.lit(event_type), F.col("project_id"), key)
        line = F.to_json(F.struct(at.cast("string").alias("created_at"), event_id.alias("event_id"), F.lit(event_type).alias("event_type"), F.struct(*[payload[k].alias(k) for k in sorted(payload)]).alias("payload"), F.struct(F.col("project_id").alias("id")).alias("project"), F.lit(1).alias("schema_version")))
        task = F.col("task") if "task" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(phase).alias("phase"), born.cast("long").alias("born"), task.alias("task"), F.lit(step).alias("step"), seq.cast("long").alias("place"), event_id.alias("event_id"), line.alias("value"))

    who = {"agent": F.coalesce("agent", agent), "external_session_id": external}
    sessions = state["sessions"].select("project_id", "session", "opened", "first.agent", F.col("first.created_at").alias("opened_at"), "last.ended_at", "last.updated_at")
    running = state["running"].select("session", F.col("last.active").alias("active"))
    ended = sessions.filter("ended_at IS NOT NULL").join(running, "session", "left")
    births = state["births"].select("project_id", "task", "born", "first.title", "first.prompt", "first.agent", "first.session", F.col("first.created_at").alias("at"))
    lines = event_rows(state["lines"])
    events = lines.join(births.select("project_id", "task", F.col("born").alias("_born")), ["project_id", "task"], "left")
    paths = F.when(F.col("path").isNotNull(), F.array("path")).otherwise(F.array().cast("array<string>"))
    event = {"agent": F.col("agent"), "external_session_id": external, "event_type": F.col("kind"), "tool_name": F.col("tool"), "data": F.col("data"), "paths": paths, "task_id": F.col("task")}
    closes = state["closes"].select("project_id", "task", F.col("at").alias("closed"), "last.status", "last.summary", "last.affected", F.col("last.created_at").alias("at")).join(births.select("project_id", "task", "born"), ["project_id", "task"])
    place = F.col("seq")
    zero = F.lit(0)
    # A session that was opened again needs both of its times: its last opening follows its first.
    again = sessions.filter("ended_at IS NULL AND updated_at <> opened_at")
    out = (
        rows(sessions, 0, 0, "session_upsert", F.col("opened_at"), zero, F.col("opened"), F.col("session"), who)
        .unionByName(rows(again, 0, 1, "session_upsert", F.col("updated_at"), zero, F.col("opened"), F.concat("session", F.lit(":again")), who))
        .unionByName(rows(ended.filter("active IS NOT NULL"), 1, 0, "session_end", F.col("ended_at"), zero, F.col("opened"), F.col("session"), who))
        .unionByName(rows(events.filter("_born IS NULL"), 2, 0, "task_event", F.col("created_at"), zero, place, F.concat_ws(":", "seq", "path"), event))
        .unionByName(rows(births, 3, 0, "task_created", F.col("at"), F.col("born"), F.col("born"), F.col("task"), {"agent": F.col("agent"), "external_session_id": external, "prompt": F.col("prompt"), "task_id": F.col("task"), "title": F.col("title")}))
        .unionByName(rows(events.filter("_born IS NOT NULL"), 3, 1, "task_event", F.col("created_at"), F.col("_born"), place, F.concat_ws(":", "seq", "path"), event))
        .unionByName(rows(closes, 3, 2, "task_closed", F.col("at"), F.col("born"), F.col("closed"), F.col("task"), {"affected_concepts": F.coalesce("affected", F.array().cast("array<struct<key:string,label:string>>")), "status": F.col("status"), "summary": F.col("summary"), "task_id": F.col("task")}))
        .unionByName(rows(ended.filter("active IS NULL"), 4, 0, "session_end", F.col("ended_at"), zero, F.col("opened"), F.col("session"), who))
    )
    return out if log is None else out.join(log.select("event_id"), "event_id", "left_anti")


BACKFILL_ORDER = ["phase", "born", "task", "step", "place", "event_id"]


def report(events: DataFrame, done: DataFrame) -> DataFrame:
    """One row: lines, how many apply, are invalid or are passed over, and projects."""
    n = events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNotNull()).alias("invalid"))
    m = done.agg(F.count(F.lit(1)).alias("applied"), F.count_distinct("project_id").alias("projects"))
    return n.crossJoin(m).select("total", "applied", (F.col("total") - F.col("applied") - F.col("invalid")).alias("skipped"), "invalid", "projects")  # one row each


def refuse_invalid(events: DataFrame) -> None:
    """A ValueError that names the first invalid line, if there is one."""
    first = events.filter("error IS NOT NULL").agg(F.min_by(F.struct("seq", "error"), "seq").alias("x")).first()["x"]
    if first is not None:
        raise ValueError(f"line {first['seq']}: {first['error']}")


def replay(events: DataFrame, file_nodes: DataFrame, concept_nodes: DataFrame, project: str | None = None, strict: bool = False) -> dict[str, DataFrame]:
    """sessions, tasks, events, nodes, edges, report and applied ids of a whole log of typed ``events``; ``strict`` refuses invalid lines."""
    if strict:
        refuse_invalid(events)
    active = active_lines(events, None, project)
    return tables(partials(active), file_nodes, concept_nodes) | {"report": report(events, active), "applied": active.select("event_id")}


class TaskState:
    """Partials of the pieces of a log in one folder; ``fold`` adds a piece.

    A piece is written to folders of its own number and counts once its mark is written last, so a fold that dies midway leaves
    nothing and may run again. Folding reads three narrow tables of earlier pieces: ids, births and running tasks; events,
    edges and closes are only ever added to. ``compact`` merges all pieces into one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def pieces(self) -> list[int]:
        """Numbers of the committed pieces."""
        system, p = self._fs(f"{self.root}/marks")
        return sorted(int(s.getPath().getName()) for s in system.listStatus(p)) if system.exists(p) else []

    def _commit(self, piece: int, replaced: list[int]) -> None:
        system, p = self._fs(f"{self.root}/marks/{piece}")
        system.create(p, True).close()
        for old in replaced:
            system.delete(self._fs(f"{self.root}/marks/{old}")[1], False)

    def partials(self, names: tuple[str, ...] = FOLDS) -> dict[str, DataFrame] | None:
        """The stored partials, or None before the first piece."""
        done = self.pieces()
        return {n: self.spark.read.parquet(*[f"{self.root}/{n}/piece={k}" for k in done]) for n in names} if done else None

    def known(self) -> dict[str, DataFrame] | None:
        """What a further piece must know: applied ids, births and running tasks."""
        got = self.partials(LOOKUPS)
        if got is None:
            return None
        running = got["running"].groupBy("session").agg(F.max_by("last", "at").alias("last")).select("session", "last.started", "last.active")
        return {"lines": got["lines"], "births": got["births"].select("project_id", "task", "born", "owner"), "running": running}

    def fold(self, events: DataFrame, project: str | None = None, strict: bool = False) -> DataFrame:
        """Add typed ``events``; lines that an earlier piece applied are passed over. The report of the piece."""
        if strict:
            refuse_invalid(events)
        active = self.add(active_lines(events, self.known(), project), max(self.pieces(), default=-1) + 1)
        return report(events, active)

    def add(self, active: DataFrame, piece: int, empty: bool = True) -> DataFrame:
        """Write a piece's lines, as ``active_lines`` gives them, and their partials; the lines read again. Unless ``empty``, no lines make no piece."""
        lines = f"{self.root}/lines/piece={piece}"
        active.write.mode("overwrite").parquet(lines)
        active = self.spark.read.parquet(lines)
        if not empty and active.isEmpty():
            system, p = self._fs(lines)
            system.delete(p, True)
            return active
        for name, df in partials(active).items():
            if name != "lines":
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/piece={piece}")
        self._commit(piece, [])
        return active

    def compact(self) -> None:
        """Merge all pieces into a new one."""
        done = self.pieces()
        if len(done) > 1:
            piece = done[-1] + 1
            for name, df in merged(self.partials()).items():
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/piece={piece}")
            self._commit(piece, done)

    def tables(self, file_nodes: DataFrame, concept_nodes: DataFrame) -> dict[str, DataFrame]:
        """sessions, tasks, events, nodes and edges of all pieces."""
        state = self.partials()
        if state is None:
            raise ValueError("no piece of a log was folded yet")
        return tables(merged(state), file_nodes, concept_nodes)


def live_sessions(found: DataFrame, projects: DataFrame) -> DataFrame:
    """Sessions with the name of their project; sessions of unknown projects are left out."""
    return found.join(projects.select("project_id", "name"), "project_id")
