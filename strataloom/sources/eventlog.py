"""The append-only log: writing envelopes on the driver, reading them as a table; evaluation cases and settings."""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import tasklog
from ..runtime import stored

SCHEMA_VERSION = 1


class LogWriter:
    """Appends one JSON line per event; the line is on disk before anything else uses the event."""

    def __init__(self, path: str, project: dict, sync: bool = True):
        self.path, self.project, self.sync = path, project, sync

    def append(self, event_type: str, payload: dict, event_id: str | None = None) -> dict:
        if event_type not in fixed.LOG_EVENT_TYPES:
            raise ValueError(f"unknown event type: {event_type}")
        row = {"schema_version": SCHEMA_VERSION, "event_id": event_id or uuid.uuid4().hex, "event_type": event_type, "created_at": datetime.now(UTC).isoformat(timespec="seconds"), "project": self.project, "payload": payload}
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n")
            f.flush()
            if self.sync:
                os.fsync(f.fileno())
        return row

    def upsert_session(self, agent: str, session: str) -> dict:
        return self.append("session_upsert", {"agent": agent, "external_session_id": session})

    def end_session(self, agent: str, session: str, **more) -> dict:
        return self.append("session_end", {"agent": agent, "external_session_id": session} | more)

    def create_task(self, agent: str, session: str, title: str, prompt: str = "") -> str:
        task = uuid.uuid4().hex
        self.append("task_created", {"task_id": task, "title": " ".join(title.split())[:160] or fixed.UNNAMED, "prompt": prompt, "agent": agent, "external_session_id": session})
        return task

    def record_event(self, agent: str, session: str, event_type: str, paths: list[str], task: str | None = None, tool: str = "", data: dict | None = None) -> dict:
        return self.append("task_event", {"task_id": task, "agent": agent, "external_session_id": session, "event_type": event_type, "tool_name": tool, "paths": list(dict.fromkeys(paths)), "data": data or {}})

    def close_task(self, task: str, status: str = "completed", summary: str = "", affected: list[dict] | None = None) -> dict:
        return self.append("task_closed", {"task_id": task, "status": status, "summary": summary, "affected_concepts": affected or []})


def parsed(lines: DataFrame) -> DataFrame:
    """seq, value, event_id, event_type, created_at, project_id, payload, error of lines(seq, value); blank lines are skipped."""
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    return lines.filter(F.trim("value") != "").select("seq", "value", get("$.event_id").alias("event_id"), get("$.event_type").alias("event_type"), get("$.created_at").alias("created_at"), get("$.project.id").alias("project_id"), get("$.payload").alias("payload"), tasklog.envelope_error("value").alias("error"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``parsed`` lines of one log file. seq follows the order of lines: partitions of one text file are in the order of its bytes."""
    return parsed(spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()))


def in_order(lines: DataFrame, order: list[str]) -> DataFrame:
    """(seq, value) of ``lines``, seq their place in the order of the columns ``order``: numbers rise from one range of a range sort to the next, with gaps; stored."""
    return stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("seq"), "value"), "log")


def session_events(lines: DataFrame) -> DataFrame:
    """session, seq, marker, task, kind, paths for ``tasklog.active_task``: starts before the first session event don't count."""
    p = lambda x: F.get_json_object("payload", x)
    ok = lines.filter("error IS NULL")
    session = F.concat(p("$.agent"), F.lit(":"), p("$.external_session_id"))
    flat = ok.select("seq", "created_at", "event_type", session.alias("session"), p("$.task_id").alias("task"), p("$.event_type").alias("kind"), F.from_json(p("$.paths"), "array<string>").alias("paths"))
    owner = flat.filter("event_type = 'task_created'").groupBy("task").agg(F.min_by("session", "seq").alias("owner"))
    known = flat.filter("event_type = 'session_upsert'").groupBy("session").agg(F.min("seq").alias("first"))
    flat = flat.join(owner, "task", "left").withColumn("session", F.coalesce("session", "owner")).drop("owner").join(known, "session", "left")
    start = (F.col("event_type") == "task_created") & (F.col("seq") > F.col("first"))
    return flat.withColumn("marker", F.when(start, "start").when(F.col("event_type") == "task_closed", "stop").when(F.col("event_type") == "session_end", "end")).drop("first")


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, task, expected_files from a JSON list, or an object that holds it under ``cases``; bad cases are an error."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # written by hand, a few cases
    data = json.loads(text)
    cases = data.get("cases") if isinstance(data, dict) else data
    if not isinstance(cases, list):
        raise ValueError("no list of cases")
    rows = []
    for c in cases:
        if not (isinstance(c, dict) and str(c.get("id", "")).strip() and str(c.get("task", "")).strip() and isinstance(c.get("expected_files"), list) and all(isinstance(x, str) for x in c["expected_files"])):
            raise ValueError(f"a case needs id, task and expected_files: {c!r}")
        rows.append((str(c["id"]), str(c["task"]), [x.replace("\\", "/").lstrip("./") for x in c["expected_files"]]))
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("case ids repeat")
    return spark.createDataFrame(rows, "id string, task string, expected_files array<string>")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of data checks: repeated ids, edges without ends, confidences outside [0, 1]."""
    ids = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, 1)), F.lit(0)).alias("repeated_ids"))
    known = nodes.select(F.col("id").alias("target_id"))
    loose = edges.join(known, "target_id", "left_anti").agg(F.count(F.lit(1)).alias("loose_targets"))
    odd = edges.agg(F.count_if(~F.col("confidence").between(0, 1)).alias("odd_confidences"))
    return ids.crossJoin(loose).crossJoin(odd)  # one row each
