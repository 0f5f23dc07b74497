"""Writing, reading and folding a log."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.operators import tasklog
from strataloom.sources import eventlog


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    w = eventlog.LogWriter(path, {"id": "shop"}, sync=False)
    w.upsert_session("a", "1")
    task = w.create_task("a", "1", "  change   the upgrade ")
    w.record_event("a", "1", "modify", ["x.py", "x.py", "y.py"])
    w.close_task(task)
    w.record_event("a", "1", "read", ["z.py"])
    with open(path, "a") as f:
        f.write('\nnot json\n{"schema_version":9}\n')
    lines = eventlog.read_lines(spark, path)
    got = tasklog.verify(lines).first()
    assert (got.lines, got.valid, got.invalid, got.duplicates, got.projects) == (7, 5, 2, 0, 1)
    active = tasklog.active_task(eventlog.session_events(lines)).filter("event_type = 'task_event'")
    touched = active.select("active_task", F.explode("paths").alias("path")).collect()
    assert {(r.active_task, r.path) for r in touched} == {(task, "x.py"), (task, "y.py"), (None, "z.py")}
    with pytest.raises(ValueError):
        w.append("other", {})


def test_cases(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text(json.dumps({"cases": [{"id": "m", "task": "t", "expected_files": ["./src\\a.py"]}]}))
    assert eventlog.evaluation_cases(spark, str(p)).first().expected_files == ["src/a.py"]
    p.write_text(json.dumps([{"id": "m", "task": "t", "expected_files": []}] * 2))
    with pytest.raises(ValueError):
        eventlog.evaluation_cases(spark, str(p))
