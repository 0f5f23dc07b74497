"""The event log as tables: verification, as-of task lookup, folds of sessions and tasks, edges, ledgers, backfill.

Events apply in the order of ``seq``, their place in the log; times have one-second resolution and ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed


def envelope_error(row: str = "value") -> Column:
    """The first rule that a log line breaks, or null."""
    v = F.try_parse_json(F.col(row))
    text = lambda p: F.try_variant_get(v, p, "string")
    return (
        F.when(v.isNull(), "invalid json").when(F.schema_of_variant(v).startswith("OBJECT") == F.lit(False), "not an object")
        .when(~F.coalesce(text("$.schema_version"), F.lit("")).eqNullSafe("1"), "unsupported schema_version").when(F.coalesce(text("$.event_id"), F.lit("")) == "", "missing event_id")
        .when(~F.coalesce(text("$.event_type"), F.lit("")).isin(fixed.LOG_EVENT_TYPES), "unknown event_type").when(F.coalesce(text("$.project.id"), F.lit("")) == "", "missing project")
        .when(text("$.payload").isNull(), "missing payload")
    )


def verify(lines: DataFrame) -> DataFrame:
    """One row of totals over lines(event_id, event_type, project_id, error): duplicates of an id still count as valid."""
    ok = F.col("error").isNull()
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), (F.count(F.when(ok, F.col("event_id"))) - F.count_distinct(F.when(ok, F.col("event_id")))).alias("duplicates"), F.count_distinct(F.when(ok, F.col("project_id"))).alias("projects"))


def unapplied(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """First occurrence of each event id that the ledger does not hold: applying twice is applying once."""
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("seq"))
    return events.join(ledger.select("event_id"), "event_id", "left_anti").withColumn("_place", place).filter("_place = 1").drop("_place")


def active_task(events: DataFrame) -> DataFrame:
    """events(session, seq, marker, task) with active_task: the session's running task as of each event.

    ``marker`` is start, stop, end or null. A start sets the active task; a stop clears it only if it names the task that was
    started last; the end of the session clears it. Both passes are running windows over the session's log.
    """
    w = Window.partitionBy("session").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last_start = F.last(F.when(F.col("marker") == "start", F.col("task")), ignorenulls=True).over(upto)
    clears = ((F.col("marker") == "stop") & (F.col("task") == F.col("_started"))) | (F.col("marker") == "end")
    effect = F.when(F.col("marker") == "start", F.struct(F.col("task").alias("t"))).when(clears, F.struct(F.lit(None).cast(events.schema["task"].dataType).alias("t")))
    return events.withColumn("_started", last_start).withColumn("_effect", effect).withColumn("active_task", F.last("_effect", ignorenulls=True).over(upto)["t"]).drop("_started", "_effect")


def task_edges(touches: DataFrame) -> DataFrame:
    """touches(task, relation, path, seq, created_at): count and last_seen_at by log order."""
    return touches.groupBy("task", "relation", "path").agg(F.count(F.lit(1)).alias("n"), F.max_by("created_at", "seq").alias("last_seen_at"))


def session_fold(events: DataFrame) -> DataFrame:
    """Sessions from events(session, seq, created_at, ends): a later event reopens an ended session."""
    return events.groupBy("session").agg(F.min("created_at").alias("created_at"), F.max_by("created_at", "seq").alias("updated_at"), F.max_by(F.when(F.col("ends"), F.col("created_at")), "seq").alias("ended_at"), F.count(F.lit(1)).alias("events"))


def task_fold(created: DataFrame, closed: DataFrame) -> DataFrame:
    """The first creation of a task wins, its last close sets status and time; created(task, seq, created_at, title), closed(task, seq, created_at, status)."""
    place = F.row_number().over(Window.partitionBy("task").orderBy("seq"))
    first = created.withColumn("_p", place).filter("_p = 1").select("task", "title", "created_at")
    last = closed.groupBy("task").agg(F.max_by(F.struct("status", F.col("created_at").alias("closed_at")), "seq").alias("c"))
    return first.join(last, "task", "left").select("task", "title", "created_at", F.coalesce("c.status", F.lit("running")).alias("status"), F.when(F.col("c.status").isin(fixed.TERMINAL_STATUSES), F.col("c.closed_at")).alias("closed_at"))


def interrupted(created: DataFrame) -> DataFrame:
    """Tasks that a later start in their session cuts off: created(session, seq, task) with next_task."""
    return created.withColumn("next_task", F.lead("task").over(Window.partitionBy("session").orderBy("seq"))).filter(F.col("next_task").isNotNull())


def snapshot(task_files: DataFrame, file_concepts: DataFrame) -> DataFrame:
    """Concepts of the files that tasks touched: task_files(task, path), file_concepts(path, concept)."""
    return task_files.select("task", "path").distinct().join(file_concepts.select("path", "concept").distinct(), "path").select("task", "concept").distinct()


def backfill_order(events: DataFrame) -> DataFrame:
    """events(phase, created_at, event_id) with seq in the order sessions, tasks, ends.

    The place of an event is the count of earlier (phase, time) steps plus its place within its step, so no task orders
    the whole log.
    """
    steps = events.groupBy("phase", "created_at").agg(F.count(F.lit(1)).alias("n"))
    per_phase = steps.groupBy("phase").agg(F.sum("n").alias("m"))
    before_phase = per_phase.withColumn("_before", F.coalesce(F.sum("m").over(Window.orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("phase", "_before")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("phase").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("_in_phase", within).join(before_phase, "phase").select("phase", "created_at", (F.col("_before") + F.col("_in_phase")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("phase", "created_at").orderBy("event_id"))
    return events.join(steps, ["phase", "created_at"]).withColumn("seq", (F.col("_offset") + place).cast("long")).drop("_offset")


def new_events(backfill: DataFrame, log: DataFrame) -> DataFrame:
    return backfill.join(log.select("event_id"), "event_id", "left_anti")
