"""Raw lifecycle rows of coding agents to events of the log.

Rows stand in the order of ``seq``. A prompt interrupts the task that still runs in its session, starts one and is recorded; a
tool call is recorded with its class and paths; a stop records the result and closes the running task; an end ends the session.
What a row emits depends on earlier rows of its session only through the running task, so one running window finds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import scalars as S

# Names of hook events, of keys that hold paths, and of payload fields in the order in which they are tried.
STOPS = ["Stop", "SubagentStop", "TaskCompleted"]
TOOLS = ["PostToolUse", "PostToolUseFailure"]
PATH_KEYS = ["path", "file_path", "filepath", "notebook_path", "target_path", "source_path"]
COMMAND_KEYS = ["command", "cmd", "script"]
PATH_LIST_KEYS = ["paths", "files", "file_paths"]
FIELDS = {
    "event": ["hook_event_name", "event_name", "event"], "session": ["session_id", "conversation_id", "thread_id"], "prompt": ["prompt", "user_prompt", "message"],
    "summary": ["last_assistant_message", "assistant_message", "result", "response"], "tool": ["tool_name", "tool"], "input": ["tool_input", "input"], "status": ["task_status", "status"], "reason": ["turn_end_reason", "reason"],
}
KEPT = ["tool_use_id", "permission_mode", "source", "reason", "dsh_event_seq", "dsh_call_seq", "dsh_turn", "dsh_step", "task_status", "turn_end_reason"]
KEPT_OF_RESPONSE = ["success", "exit_code", "status", "error"]
TITLE, PROMPT, COMMAND = 160, 8000, 4000


def field(name: str) -> Column:
    """The first non-empty of a field's names in the payload; of an object its text or content."""
    def one(k: str) -> Column:
        whole = F.get_json_object("payload", f"$.{k}")
        inner = F.coalesce(F.get_json_object("payload", f"$.{k}.text"), F.get_json_object("payload", f"$.{k}.content"))
        return F.coalesce(inner, whole) if name in ("prompt", "summary") else whole

    return F.coalesce(*[F.when(F.trim(one(k)) != "", F.trim(one(k))) for k in FIELDS[name]])


def _walk(value: object, key: str = "") -> Iterator[str]:
    """Strings of a JSON value that stand under path keys."""
    todo = [(value, key)]
    while todo:
        v, k = todo.pop()
        if isinstance(v, dict):
            todo += [(x, str(name).lower()) for name, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(x, PATH_KEYS[0] if k in PATH_LIST_KEYS and isinstance(x, str) else k) for x in reversed(v)]
        elif isinstance(v, str):
            if k in PATH_KEYS:
                yield v
            yield from re.findall(r"(?m)^\*\*\* (?:Update|Add|Delete) File: (.+)$", v)


def command() -> Column:
    """The shell command of a tool call: the input itself if it is a text, else one of its fields, else its list of commands."""
    given = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in FIELDS["input"]])
    inner = [F.get_json_object(given, f"$.{k}") for k in COMMAND_KEYS]
    listed = F.array_join(F.from_json(F.get_json_object(given, "$.commands"), "array<string>"), "\n")
    return F.coalesce(F.when(F.startswith(F.ltrim(given), F.lit("{")), F.coalesce(*inner, listed, F.lit(""))), F.when(~F.startswith(F.ltrim(given), F.lit("[")), given), F.lit(""))


def named_files(of: Column) -> Column:
    """Words of a command that could name a file: quoted or bare, neither an option nor a pattern. The inventory decides which are files."""
    words = F.transform(F.regexp_extract_all(of, F.lit(r"""(?:[^\s'"|&;]|'[^']*'|"[^"]*")+"""), F.lit(0)), lambda w: F.regexp_replace(w, "['\"]", ""))
    return F.array_distinct(F.filter(words, lambda w: ~w.rlike(r"^(-.*)?$|[$*?{}<>]")))


_TEXTS = T.ArrayType(T.StringType())


def _loads(text: str | None) -> object:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return text


@F.pandas_udf(_TEXTS)
def json_paths(given: pd.Series, answer: pd.Series) -> pd.Series:
    """Paths that the input and the answer of a tool call name under path keys, at any depth, and in patches."""
    return pd.Series([list(dict.fromkeys(p.strip() for p in [*_walk(_loads(a)), *_walk(_loads(b))] if p.strip())) for a, b in zip(given, answer, strict=True)], dtype=object)


def end_status() -> Column:
    """Final state by the payload's own status, else by the reason of the turn's end."""
    reason = F.coalesce(*[F.get_json_object("payload", f"$.{k}.kind") for k in FIELDS["reason"]])
    cause = F.coalesce(*[F.get_json_object("payload", f"$.{k}.reason.kind") for k in FIELDS["reason"]])
    return S.end_status(F.lower(field("status")), F.lower(F.trim(reason)), F.lower(F.trim(cause)))


def kept_data() -> Column:
    """The whitelisted fields of a payload as JSON."""
    pick = lambda names, root: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.get_json_object("payload", f"{root}.{k}") for k in names])), lambda _, v: v.isNotNull())
    return F.to_json(F.struct(pick(KEPT, "$").alias("fields"), pick(KEPT_OF_RESPONSE, "$.tool_response").alias("response")))


def ingest(hooks: DataFrame, inventory: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """Events of hooks(seq, project_id, agent, created_at, payload JSON): seq, step, event_type, session, task, kind, tool, paths, title, prompt, status, summary, data, event_id.

    inventory(project_id, path) decides which words of a shell command are files. Paths are relative to their project: an absolute one
    below the root that projects(project_id, root) names loses it, one outside is dropped. Ids of tasks and events follow from the rows,
    so the same hooks always give the same log.
    """
    h = hooks.select("seq", "project_id", "agent", "created_at", "payload", F.coalesce(field("event"), F.lit("")).alias("event"), F.coalesce(field("session"), F.lit("unknown-session")).alias("external"))
    h = h.withColumn("session", S.session_key(F.col("agent"), F.col("external"))).withColumn("own", S.stable_id("task_", F.col("project_id"), F.col("session"), F.col("seq").cast("string")))
    effect = F.when(F.col("event") == "UserPromptSubmit", F.struct(F.col("own").alias("t"))).when(F.col("event").isin(*STOPS, "SessionEnd"), F.struct(F.lit(None).cast("string").alias("t")))
    earlier = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("running", F.last(effect, ignorenulls=True).over(earlier)["t"])

    roots = hooks.sparkSession.createDataFrame([], "project_id string, root string") if projects is None else projects.select("project_id", F.regexp_replace("root", "/+$", "").alias("root"))
    relative = lambda paths: F.array_distinct(F.filter(F.transform(paths, lambda p: S.event_path(p, F.col("root"))), lambda p: p.isNotNull() & (p != "")))
    calls = h.filter(F.col("event").isin(TOOLS)).join(roots, "project_id", "left").withColumn("command", command())
    calls = calls.withColumn("paths", json_paths(F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in FIELDS["input"]]), F.get_json_object("payload", "$.tool_response"))).withColumn("paths", relative("paths"))
    said = calls.select("project_id", "seq", F.posexplode(relative(named_files(F.col("command")))).alias("i", "path"))
    files = said.join(inventory.select("project_id", "path"), ["project_id", "path"], "left_semi").groupBy("project_id", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "path"))), lambda x: x["path"]).alias("files"))
    calls = calls.join(files, ["project_id", "seq"], "left")

    none = F.lit(None).cast("string")
    no_paths = F.array().cast("array<string>")

    def emit(df: DataFrame, step: int, event_type: str, task=none, kind=none, tool=none, paths=no_paths, title=none, prompt=none, status=none, summary=none, data=none) -> DataFrame:
        row = {"task": task, "kind": kind, "tool": tool, "paths": paths, "title": title, "prompt": prompt, "status": status, "summary": summary, "data": data}
        return df.select("seq", F.lit(step).alias("step"), F.lit(event_type).alias("event_type"), "project_id", "agent", "session", "created_at", *[v.alias(k) for k, v in row.items()])

    prompts, stops = h.filter("event = 'UserPromptSubmit'"), h.filter(F.col("event").isin(STOPS) & F.col("running").isNotNull())
    prompt = F.coalesce(field("prompt"), F.lit(""))
    title = F.when(prompt != "", F.substring(F.split(prompt, "\n").getItem(0), 1, TITLE)).otherwise(F.lit(fixed.UNNAMED))
    run = F.col("command")
    kind = F.concat(S.tool_class(F.coalesce(field("tool"), F.lit("")), run), F.when(F.col("event") == "PostToolUseFailure", "_failed").otherwise(""))
    call_data = F.to_json(F.struct(F.when(run != "", F.substring(run, 1, COMMAND)).alias("command"), kept_data().alias("more")))
    summary = F.substring(F.coalesce(field("summary"), F.lit("")), 1, PROMPT)
    others = h.filter(~F.col("event").isin("SessionStart", "UserPromptSubmit", "SessionEnd", *TOOLS, *STOPS))
    out = [
        emit(h.filter(F.col("event").isin("SessionStart", "UserPromptSubmit")), 0, "session_upsert"),
        emit(prompts.filter("running IS NOT NULL"), 1, "task_closed", F.col("running"), status=F.lit("interrupted"), summary=F.lit("")),
        emit(prompts, 2, "task_created", F.col("own"), title=title, prompt=prompt),
        emit(prompts, 3, "task_event", F.col("own"), F.lit("prompt"), data=F.to_json(F.struct(F.substring(prompt, 1, PROMPT).alias("prompt"), kept_data().alias("more")))),
        emit(calls, 0, "task_event", kind=kind, tool=field("tool"), paths=F.array_distinct(F.concat("paths", F.coalesce("files", no_paths))), data=call_data),
        emit(stops, 0, "task_event", F.col("running"), F.lit("result"), data=F.to_json(F.struct(summary.alias("summary"), end_status().alias("status"), kept_data().alias("more")))),
        emit(stops, 1, "task_closed", F.col("running"), status=end_status(), summary=summary),
        emit(h.filter("event = 'SessionEnd'"), 0, "session_end"),
        emit(others, 0, "task_event", kind=F.when(F.col("event") == "", "unknown").otherwise(F.col("event")), data=F.to_json(F.struct(F.array_sort(F.json_object_keys("payload")).alias("payload_keys")))),
    ]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.withColumn("event_id", S.stable_id("event_", F.col("project_id"), F.col("session"), F.col("seq").cast("string"), F.col("step").cast("string")))


def pair_calls(calls: DataFrame) -> DataFrame:
    """Each call of a tool with its answer by call id within a session: calls(session, call_id, seq, role, value), role call or result.

    Of calls and of answers that repeat an id the first of each counts; a call without an answer stays with nulls.
    """
    first = lambda role, name: calls.filter(F.col("role") == role).groupBy("session", "call_id").agg(F.min("seq").alias(f"{name}_seq"), F.min_by("value", "seq").alias(name))
    return first("call", "asked").join(first("result", "answer"), ["session", "call_id"], "left")


def backfill(sessions: DataFrame, tasks: DataFrame, events: DataFrame, log: DataFrame) -> DataFrame:
    """Events that stored state implies and ``log(event_id)`` lacks: sessions, then each task with its events and its close, then ends.

    sessions(project_id, session, created_at, ended_at), tasks(project_id, task, session, created_at, status, closed_at),
    events(project_id, task, session, seq, created_at, kind). Ids follow from the keys, so a second run adds nothing.
    """
    def rows(df: DataFrame, phase: int, event_type: str, key: Column, at: Column, task: Column, kind: Column) -> DataFrame:
        return df.select(F.lit(phase).alias("phase"), at.alias("created_at"), S.stable_id("event_", F.lit(event_type), F.col("project_id"), key).alias("event_id"), F.lit(event_type).alias("event_type"), "project_id", "session", task.alias("task"), kind.alias("kind"))

    none = F.lit(None).cast("string")
    task = F.col("task").cast("string")
    out = (
        rows(sessions, 0, "session_upsert", F.col("session"), F.col("created_at"), none, none).unionByName(rows(tasks, 1, "task_created", task, F.col("created_at"), task, none))
        .unionByName(rows(events, 2, "task_event", F.concat_ws(":", "session", "seq"), F.col("created_at"), task, F.col("kind")))
        .unionByName(rows(tasks.filter("closed_at IS NOT NULL"), 3, "task_closed", task, F.col("closed_at"), task, F.col("status"))).unionByName(rows(sessions.filter("ended_at IS NOT NULL"), 4, "session_end", F.col("session"), F.col("ended_at"), none, none))
    )
    return out.join(log.select("event_id"), "event_id", "left_anti")
