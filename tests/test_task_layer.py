"""The task layer, lifecycle ingest, corrections, reports, store and vault on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataloom.operators import grams, layer3, lifecycle, overlay, reports, routing, search, semantic
from strataloom.plans import replay_queries, vault
from strataloom.sources import eventlog, grammar, store
from strataloom.streaming import tasks


def lines(spark, tmp_path, rows):
    path = tmp_path / "log.jsonl"
    path.write_text("".join(json.dumps({"schema_version": 1, "event_id": i, "event_type": t, "created_at": f"2024-01-01T00:00:{k:02d}", "project": {"id": "p"}, "payload": x}) + "\n" if isinstance(x, dict) else x + "\n" for k, (i, t, x) in enumerate(rows)), encoding="utf-8")
    return eventlog.read_lines(spark, str(path))


S = {"agent": "a", "external_session_id": "s"}


def test_log_to_graph_rows(spark, tmp_path):
    rows = [
        ("1", "session_upsert", S), ("2", "task_created", S | {"task_id": "t1", "title": "One"}), ("3", "task_event", S | {"event_type": "read", "paths": ["a.py", "a.py", "b.py"]}),
        ("4", "task_event", S | {"event_type": "modify", "paths": ["a.py"], "task_id": "t1"}), ("4", "task_event", S | {"event_type": "modify", "paths": ["a.py"]}), ("5", "task_closed", {"task_id": "t1", "status": "completed", "affected_concepts": [{"key": "pay", "label": "Pay"}]}),
        ("6", "task_created", S | {"task_id": "t2", "title": "Two"}), ("7", "task_event", S | {"event_type": "command", "paths": []}), ("8", "session_end", S), ("9", "task_event", S | {"event_type": "read", "paths": ["c.py"]}),
        ("10", "task_closed", {"task_id": "nobody"}), ("11", "x", "{broken"), ("12", "session_upsert", S),
    ]
    files = spark.createDataFrame([("p", "a.py")], "project_id string, key string")
    typed = layer3.typed(lines(spark, tmp_path, rows))
    got = layer3.replay(typed, files, files.limit(0))
    assert {(r.task, r.status, r.closed_at is None) for r in got["tasks"].collect()} == {("t1", "completed", False), ("t2", "interrupted", False)}
    assert [(r.session, r.ended_at, r.updated_at[-2:]) for r in got["sessions"].collect()] == [("a:s", None, "12")]  # opened again after its end
    assert sorted((r.seq is not None, r.task or "", r.path or "") for r in got["events"].collect()) == sorted([(True, "t1", "a.py"), (True, "t1", "b.py"), (True, "t1", "a.py"), (True, "t2", ""), (True, "", "c.py")])
    assert {(r.layer, r.kind, r.key) for r in got["nodes"].collect()} == {(3, "task", "t1"), (3, "task", "t2"), (1, "file", "b.py"), (2, "concept", "pay")}
    assert sorted((r.relation, json.loads(r.data).get("count", 0)) for r in got["edges"].collect()) == [("affects", 0), ("modified", 1), ("read", 1), ("read", 1)]
    assert got["report"].first().asDict() == {"total": 13, "applied": 10, "skipped": 2, "invalid": 1, "projects": 1}
    state = layer3.TaskState(spark, f"file://{tmp_path}/state")
    assert state.fold(typed).first().applied == 10 and state.fold(typed).first().asDict() == {"total": 13, "applied": 0, "skipped": 12, "invalid": 1, "projects": 0}
    assert rows_of(state.tables(files, files.limit(0))) == rows_of(got)
    with pytest.raises(ValueError, match="invalid json"):
        layer3.replay(typed, files, files, strict=True)


def rows_of(got):
    return {k: sorted(map(str, got[k].select(*sorted(got[k].columns)).collect())) for k in ("sessions", "tasks", "events", "nodes", "edges")}


def test_a_second_replay_knows_what_the_first_left(spark, tmp_path):
    """Two lines are folded, then all four: the close and the edge need the task and the session of the first two."""
    rows = [("1", "session_upsert", S), ("2", "task_created", S | {"task_id": "t", "title": "T"}), ("3", "task_event", S | {"event_type": "read", "paths": ["a.py"]}), ("4", "task_closed", {"task_id": "t", "status": "completed"})]
    typed = layer3.typed(lines(spark, tmp_path, rows))
    state = layer3.TaskState(spark, f"file://{tmp_path}/state")
    assert state.fold(typed.filter("event_id < '3'")).first().applied == 2 and state.fold(typed).first().applied == 2
    nothing = spark.createDataFrame([], "project_id string, key string")
    got = state.tables(nothing, nothing)
    assert [(r.task, r.status) for r in got["tasks"].collect()] == [("t", "completed")] and got["events"].first().task == "t" and got["edges"].first().relation == "read"


def one_by_one(rows):
    """(tasks, events, edges, sessions) of a log by a loop over its lines."""
    seen, running, started, owner, tasks, events, edges, sessions = set(), {}, {}, {}, {}, [], {}, {}
    for k, (i, t, x) in enumerate(rows):
        if i in seen:
            continue
        seen.add(i)
        task, session = x.get("task_id"), f"a:{x['external_session_id']}" if "external_session_id" in x else None
        if t == "task_closed" and task not in owner:
            continue
        session = session or owner.get(task)
        if t in ("session_upsert", "session_end"):
            sessions[session] = f"{k:02d}" if t == "session_end" else None
        if t == "task_created":
            owner.setdefault(task, session)
            tasks.setdefault(task, "running")
            running[session] = started[session] = task
        elif t == "task_event":
            who = task or running.get(session)
            for p in dict.fromkeys(x["paths"]):
                events.append((k, who, p))
                if who:
                    edges[who, p] = edges.get((who, p), 0) + 1
        elif t == "task_closed":
            tasks[task] = x["status"]
            if started.get(session) == task:
                running.pop(session, None)
        elif t == "session_end" and running.pop(session, None) is not None:
            tasks[started[session]] = "interrupted"
    return tasks, sorted(events, key=str), edges, sessions


@pytest.mark.parametrize("block", [2])
def test_pieces_equal_a_loop_over_the_log(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(layer3, "BLOCK_ROWS", block)
    r = random.Random(block)
    rows = []
    for k in range(99):
        x = {"agent": "a", "external_session_id": f"s{r.randrange(3)}"}
        t = r.choice(["session_upsert", "session_end", "task_created", "task_created", "task_event", "task_event", "task_event", "task_closed"])
        if t == "task_created":
            x |= {"task_id": f"t{r.randrange(30)}"}
        elif t == "task_closed":
            x = {"task_id": f"t{r.randrange(30)}", "status": r.choice(["completed", "failed", "running"])}
        elif t == "task_event":
            x |= {"event_type": "read", "paths": [f"f{r.randrange(4)}", "f0"]} | ({"task_id": f"t{r.randrange(30)}"} if r.random() < 0.2 else {})
        rows.append((f"e{r.randrange(90)}" if r.random() < 0.1 else f"n{k}", t, x))
    typed = layer3.typed(lines(spark, tmp_path, rows)).withColumn("seq", F.substring("created_at", 18, 2).cast("long"))
    nothing = spark.createDataFrame([], "project_id string, key string")
    state = layer3.TaskState(spark, f"file://{tmp_path}/state")
    for k, cut in enumerate(sorted(r.sample(range(1, 98), 3)) + [99]):
        state.fold(typed.filter(F.col("seq") <= cut))
        if k == 1:
            state.compact()
    got = state.tables(nothing, nothing)
    assert rows_of(got) == rows_of(layer3.replay(typed, nothing, nothing))
    states, events, edges, sessions = one_by_one(rows)
    assert {x.task: x.status for x in got["tasks"].collect()} == states
    assert sorted(((x.seq, x.task, x.path) for x in got["events"].collect()), key=str) == events
    assert sorted(json.loads(x.data)["count"] for x in got["edges"].collect()) == sorted(edges.values())
    assert {x.session: x.ended_at and x.ended_at[-2:] for x in got["sessions"].collect()} == sessions


def test_a_stream_equals_the_whole_log(spark, tmp_path):
    """Files bring the lines in a random order, some twice; closes name only their task."""
    r = random.Random(6)
    rows, made = [], []
    for k in range(60):
        x = {"agent": "a", "external_session_id": f"s{r.randrange(3)}"}
        t = r.choice(["session_upsert", "session_end", "task_created", "task_event", "task_event", "task_closed"])
        if t == "task_created":
            x |= {"task_id": f"t{k}"}
            made.append(f"t{k}")
        elif t == "task_closed":
            x = {"task_id": r.choice([*made, "nobody"]), "status": "completed", "affected_concepts": [{"key": f"c{k % 3}", "label": "C"}]}
        elif t == "task_event":
            x |= {"event_type": "modify", "paths": [f"f{r.randrange(4)}"]}
        rows.append((f"n{k}", t, x))
    typed = layer3.typed(lines(spark, tmp_path, rows)).withColumn("seq", F.substring("created_at", 18, 2).cast("long"))
    log = f"file://{tmp_path}/log"
    for k in range(3):
        part = typed.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)
        part.unionByName(typed.filter("seq % 20 = 7")).coalesce(1).withColumn("_k", F.lit(k)).write.mode("append").partitionBy("_k").parquet(log)
    tasks.flush_line(typed, 1000).withColumn("_k", F.lit(9)).write.mode("append").partitionBy("_k").parquet(log)
    stream = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(log)
    state = layer3.TaskState(spark, f"file://{tmp_path}/streamed")
    tasks.stream_into(stream, state, f"file://{tmp_path}/offsets", 60).awaitTermination()
    nothing = spark.createDataFrame([], "project_id string, key string")
    got = state.tables(nothing, nothing)
    want = layer3.replay(typed, nothing, nothing)
    whole, expected = rows_of(got), rows_of(want)
    assert whole == expected and whole["tasks"] and whole["edges"]


def test_a_stream_of_many_sessions_keeps_few_keys(spark, tmp_path):
    """Three files of which each releases lines of the one before: 1500 sessions of one and the same trigger share keys of state, and some lines name no session."""
    r = random.Random(8)
    rows, slice_ = [], 2000
    for k in range(3 * slice_):
        x = {"agent": "a", "external_session_id": f"s{k % 1500}"}
        t = r.choice(["session_upsert", "session_end", "task_created", "task_event", "task_event", "task_closed"])
        if t == "task_created":
            x |= {"task_id": f"t{k}"}
        elif t == "task_closed":
            x = ({} if k % 2 else x) | {"task_id": f"t{r.randrange(k + 50)}", "status": "completed"}
        elif t == "task_event":
            x = ({} if k % 5 == 0 else x) | {"event_type": "read", "paths": [f"f{k % 7}"]} | ({"task_id": f"t{r.randrange(k + 1)}"} if k % 5 == 1 else {})
        rows.append((k, f"n{k}", t, f"2024-01-01 {k}", "p", json.dumps(x), None))
    typed = layer3.typed(spark.createDataFrame(rows, "seq long, event_id string, event_type string, created_at string, project_id string, payload string, error string"))
    log = f"file://{tmp_path}/log"
    for k in range(3):
        piece = typed.filter(F.floor(F.col("seq") / slice_) == k)
        piece.unionByName(piece.filter("seq % 20 = 7")).repartition(3).sortWithinPartitions(F.xxhash64("event_id")).coalesce(1).withColumn("_k", F.lit(k)).write.mode("append").partitionBy("_k").parquet(log)
    tasks.flush_line(typed, 100_000).withColumn("_k", F.lit(9)).write.mode("append").partitionBy("_k").parquet(log)
    stream = spark.readStream.schema(typed.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(log)
    state, own = layer3.TaskState(spark, f"file://{tmp_path}/streamed"), dict(spark.conf.getAll)
    query = tasks.stream_into(stream, state, f"file://{tmp_path}/offsets", slice_ + 300)
    query.awaitTermination()
    nothing = spark.createDataFrame([], "project_id string, key string")
    assert rows_of(state.tables(nothing, nothing)) == rows_of(layer3.replay(typed, nothing, nothing)) and len(state.pieces()) >= 2
    first = next(p for p in query.recentProgress if p["batchId"] == 0)
    kept = [o["numRowsTotal"] for o in first["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert kept and kept[0] <= 1100
    assert dict(spark.conf.getAll) == own


def test_hooks_equal_a_sequential_ingest(spark):
    r = random.Random(3)
    rows, want, running = [], [], {}
    for seq in range(200):
        s, e = f"s{r.randrange(4)}", r.choice(["SessionStart", "UserPromptSubmit", "PostToolUse", "Stop", "SessionEnd", "Other"])
        rows.append((seq, "p", "a", f"{seq}", json.dumps({"hook_event_name": e, "session_id": s, "prompt": f"do {seq}", "tool_name": "Edit", "tool_input": {"edits": [{"file_path": "x.py"}], "paths": ["y.py"]}, "turn_end_reason": {"kind": "aborted", "reason": {"kind": "user"}}})))
        if e in ("SessionStart", "UserPromptSubmit"):
            want.append((seq, "session_upsert", None, None))
        if e == "UserPromptSubmit":
            if s in running:
                want.append((seq, "task_closed", None, "interrupted"))
            want += [(seq, "task_created", None, None), (seq, "task_event", "prompt", None)]
            running[s] = seq
        elif e == "PostToolUse":
            want.append((seq, "task_event", "modify", None))
        elif e == "Stop" and running.pop(s, None) is not None:
            want += [(seq, "task_event", "result", None), (seq, "task_closed", None, "cancelled")]
        elif e == "SessionEnd":
            want.append((seq, "session_end", None, None))
            running.pop(s, None)
        elif e == "Other":
            want.append((seq, "task_event", "Other", None))
    hooks = spark.createDataFrame(rows, "seq long, project_id string, agent string, created_at string, payload string")
    got = lifecycle.ingest(hooks, spark.createDataFrame([], "project_id string, path string")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.seq, x.event_type, x.kind, x.status) for x in got), key=key) == sorted(want, key=key)
    assert all(x.paths == ["x.py", "y.py"] for x in got if x.kind == "modify") and len({x.event_id for x in got}) == len(got)


def test_shell_words_are_files_only_if_known(spark):
    call = {"hook_event_name": "PostToolUse", "session_id": "s", "tool_name": "Bash", "tool_input": {"command": "cat ./a.py 'b c.py' -n none.py $X *.py"}}
    hooks = spark.createDataFrame([(1, "p", "a", "t", json.dumps(call))], "seq long, project_id string, agent string, created_at string, payload string")
    known = spark.createDataFrame([("p", "a.py"), ("p", "b c.py"), ("q", "none.py")], "project_id string, path string")
    assert lifecycle.ingest(hooks, known).first().paths == ["a.py", "b c.py"]


def test_paths_of_tool_calls_are_relative_to_their_project(spark):
    calls = [{"file_path": "/home/u/proj/src/x.py"}, {"file_path": "/home/u/project/x.py"}, {"paths": ["src/../y.py", "../out.py"]}, {"command": "cat '/home/u/proj/a b.py' /etc/passwd src/./x.py"}, "sed -n 1p x.py; cat src/x.py", {"commands": ["ls", "cat x.py"]}]
    rows = [(k, "p", "a", "t", json.dumps({"hook_event_name": "PostToolUse", "session_id": "s", "tool_name": "Bash", "tool_input": c})) for k, c in enumerate(calls)]
    hooks = spark.createDataFrame(rows, "seq long, project_id string, agent string, created_at string, payload string")
    known = spark.createDataFrame([("p", "a b.py"), ("p", "src/x.py"), ("p", "x.py"), ("p", "etc/passwd")], "project_id string, path string")
    projects = spark.createDataFrame([("p", "/home/u/proj")], "project_id string, root string")
    got = lifecycle.ingest(hooks, known, projects).orderBy("seq").collect()
    assert [r.paths for r in got] == [["src/x.py"], [], ["y.py"], ["a b.py", "src/x.py"], ["x.py", "src/x.py"], ["x.py"]]
    assert json.loads(got[4].data)["command"] == calls[4] and json.loads(got[5].data)["command"] == "ls\ncat x.py"


def test_calls_pair_by_id(spark):
    rows = [("s", "1", 1, "call", "x"), ("s", "1", 4, "result", "y"), ("s", "2", 2, "call", "z"), ("t", "1", 3, "result", "w"), ("s", "1", 5, "result", "late")]
    got = lifecycle.pair_calls(spark.createDataFrame(rows, "session string, call_id string, seq int, role string, value string")).collect()
    assert {(r.session, r.call_id, r.asked, r.answer) for r in got} == {("s", "1", "x", "y"), ("s", "2", "z", None)}


def corrections(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, action string, subject_key string, relation string, object_key string, value string")


def test_corrections_in_all_phases(spark):
    rows = [
        ("rename_concept", "a", "", "", "Alpha"), ("merge_concept", "b", "", "c", ""), ("merge_concept", "c", "", "d", ""), ("create_concept", "n", "", "", "New"), ("reject_concept", "r", "", "", ""),
        ("add_edge", "a", "uses", "n", ""), ("accept_edge", "a", "uses", "d", ""), ("reject_edge", "x", "uses", "a", ""), ("map_file", "n", "implemented_by", "f.py", ""), ("map_file", "n", "implemented_by", "gone.py", ""), ("unmap_file", "a", "implemented_by", "g.py", ""),
    ]
    concepts = spark.createDataFrame([(k, k.upper(), True, [], 0.7, "h") for k in "abcdrx"], "key string, label string, active boolean, aliases array<string>, confidence double, source string")
    edges = spark.createDataFrame([(2, "b", "uses", "x", "concept", "{}"), (2, "x", "uses", "b", "concept", "{}"), (2, "x", "uses", "a", "concept", "{}"), (2, "r", "uses", "a", "concept", "{}"), (2, "b", "uses", "c", "concept", "{}"), (2, "a", "implemented_by", "g.py", "file", "{}"), (2, "b", "implemented_by", "g.py", "file", "{}"), (3, "t1", "affects", "b", "concept", "{}")], "layer int, source string, relation string, target string, target_kind string, data string")
    files = spark.createDataFrame([("f.py",), ("g.py",)], "path string")
    after, out = overlay.apply_all(concepts, edges, files, overlay.last_per_slot(corrections(spark, rows)))
    c = {r.key: r for r in after.collect()}
    assert c["a"].label == "Alpha" and c["n"].label == "New" and not c["r"].active and c["b"].merged_into == c["c"].merged_into == "d" and not c["b"].active
    got = {(r.layer, r.source, r.relation, r.target): (r.merged_from, r.review_decision) for r in out.collect()}
    assert got == {
        (2, "d", "uses", "x"): ("b", None), (2, "x", "uses", "d"): ("b", None), (2, "d", "implemented_by", "g.py"): ("b", None), (3, "t1", "affects", "d"): ("b", None), (2, "b", "merged_into", "d"): ("b", None), (2, "c", "merged_into", "d"): ("c", None),
        (2, "a", "uses", "n"): (None, "manual"), (2, "a", "uses", "d"): (None, "accepted"), (2, "n", "implemented_by", "f.py"): (None, None),
    }


def test_removed_corrections_and_places_of_aliases(spark):
    rows = [("add_alias", "a", "", "", "x"), ("add_alias", "a", "", "", "y"), ("remove", "a", "", "x", "add_alias"), ("add_alias", "a", "", "", "x"), ("rename_concept", "a", "", "", "N"), ("remove", "a", "", "", "rename_concept")]
    got = {(r.action, r.value, r.order_seq) for r in overlay.last_per_slot(corrections(spark, rows)).collect()}
    assert got == {("add_alias", "x", 3), ("add_alias", "y", 1)}


def test_normal_form_and_errors_of_corrections(spark):
    rows = [("rename_concept", " My Key ", "", "", "L"), ("map_file", "a", "", ".\\src\\x.py", ""), ("merge_concept", "a", "", "A", ""), ("add_alias", "a", "", "", " "), ("other", "a", "", "", ""), ("rename_concept", "Billing & Pay", "", "", "B"), ("add_edge", "ＡＢ", "uses", "__x y__", "")]
    got = [(r.subject_key, r.relation, r.object_key, r.error) for r in overlay.checked(corrections(spark, rows)).orderBy("seq").collect()]
    assert got == [("my-key", "", "", None), ("a", "implemented_by", "src/x.py", None), ("a", "", "a", "no other concept"), ("a", "", "", "no value"), ("a", "", "", "unknown action"), ("billing-pay", "", "", None), ("ab", "uses", "x-y", None)]
    queue = spark.createDataFrame([("edge", "a", "uses", "b", 0.5), ("concept", "c", "", "", 0.4)], "kind string, subject string, relation string, object string, confidence double")
    assert {(r.seq, r.action, r.subject_key, r.object_key) for r in overlay.decide(queue, "reject", 7).collect()} == {(7, "reject_concept", "c", ""), (8, "reject_edge", "a", "b")}


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([("f1", "p", 1, "file", "src/a.py", "a.py", True, '{"size":5}'), ("f2", "p", 1, "file", "src/b.py", "b.py", True, '{"size":-1}'), ("r1", "p", 1, "symbol", "src/a.py#x", "x", True, "{}"), ("c1", "p", 2, "concept", "one", "One", True, "{}"), ("c2", "p", 2, "concept", "two", "Two", False, "{}"), ("t1", "p", 3, "task", "t", "T", True, "{}"), ("h", "p", 1, "file", "ghost.py", "g", True, '{"placeholder":true}')], "id string, project_id string, layer int, kind string, key string, label string, active boolean, data string")
    edges = spark.createDataFrame([("p", 1, "f1", "imports", "f2"), ("p", 1, "f1", "contains", "r1"), ("p", 2, "c1", "implemented_by", "f1"), ("p", 2, "c1", "depends_on", "c2"), ("p", 3, "t1", "read", "f1"), ("p", 3, "t1", "read", "h")], "project_id string, layer int, source_id string, relation string, target_id string")
    return nodes, edges


def test_reports(spark, small):
    nodes, edges = small
    tasks = spark.createDataFrame([("t", "T", "2024")], "task string, title string, created_at string")
    got = {(r.section, r.relation, r.key) for r in reports.file_impact(nodes, edges, tasks, "p", "a.py").collect()}
    assert got == {("file", "", "src/a.py"), ("outgoing", "imports", "src/b.py"), ("outgoing", "contains", "src/a.py#x"), ("concept", "", "one"), ("neighbour", "depends_on", "two"), ("task", "read", "t")}
    assert reports.file_impact(nodes, edges, tasks, "p", "src").first().section == "error" and "no file" in reports.file_impact(nodes, edges, tasks, "p", "zzz").first().label
    s = reports.statistics(nodes, edges).first()
    assert (s.files, s.concepts, s.tasks, s.physical_edges, s.semantic_edges) == (3, 1, 1, 2, 2)
    assert {(r.path, r.size) for r in reports.inventory(nodes).collect()} == {("src/a.py", 5), ("src/b.py", 0), ("ghost.py", 0)}
    left_nodes, left_edges = reports.reset_layer(nodes, edges, 3)
    assert {r.id for r in left_nodes.collect()} == {"f1", "f2", "r1", "c1", "c2"} and left_edges.count() == 4
    left_nodes, left_edges = reports.remove_file(nodes, edges, "p", "src/a.py")
    assert {r.id for r in left_nodes.collect()} == {"f2", "c1", "c2", "t1", "h"} and {r.relation for r in left_edges.collect()} == {"depends_on", "read"}


def test_candidates_of_all_modes(spark):
    cases = spark.createDataFrame([("k", "pay upgrade", ["src/pay.py"]), ("b", "brand", ["src/brand_13/x.py"]), ("n", "zzz", ["docs/x.md"])], "case_key string, query string, expected array<string>")
    rows = [("src/pay.py", "pay", 8), ("src/other.py", "about pay", 4), ("docs/x.md", "x", 40), ("src/brand_13/x.py", "x.py", 6)]
    files = spark.createDataFrame(rows, "path string, label string, size long")
    nodes = spark.createDataFrame([(f"f{p}", 1, "file", p, label, "{}", True, []) for p, label, _ in rows] + [("c1", 2, "concept", "shop", "Upgrade", "{}", True, []), ("c2", 2, "concept", "old", "Old", "{}", False, ["brand"])], "id string, layer int, kind string, key string, label string, data string, active boolean, aliases array<string>")
    edges = spark.createDataFrame([("c1", "implemented_by", "fsrc/other.py"), ("c1", "implemented_by", "fdocs/x.md")], "source_id string, relation string, target_id string")
    found = reports.candidates(cases, nodes, edges).collect()
    by = lambda case, mode: {r.path for r in found if r.case_key == case and r["mode"] == mode}
    assert by("k", "filename-search") == {"src/pay.py", "src/other.py"} and by("b", "filename-search") == {"src/brand_13/x.py"} and by("n", "filename-search") == set()
    assert by("k", "routed") == {"src/pay.py", "src/other.py", "docs/x.md"} and by("b", "routed") == {"src/brand_13/x.py"} and len(by("n", "full-scan")) == 4
    names = {(r.case_key, r.path): r.score for r in routing.named_files(cases, files).collect()}
    assert names["b", "src/brand_13/x.py"] == 4.5 and names["k", "src/pay.py"] == 10.0 and names["k", "src/other.py"] == 3.0
    runs = {(r.case_key, r["mode"]): r for r in reports.run_suite(cases, reports.candidates(cases, nodes, edges), files).collect()}
    assert runs["k", "full-scan"].candidates == 4 and runs["k", "routed"].recall == 1.0 and runs["k", "filename-search"].precision == 0.5 and runs["n", "routed"].candidates == 0


def test_contexts_equal_one_context_for_each_query(spark):
    r = random.Random(4)
    words = ["pay", "cart", "user", "login", "report", "mail"]
    nodes = [(f"f{k}", 1, "file", f"src/{r.choice(words)}/{r.choice(words)}_{k}.py", r.choice(words), "{}", True, [], "t") for k in range(40)]
    nodes += [(f"c{k}", 2, "concept", f"{w}-{k}", w.title(), '{"x":"mail"}', k != 2, [f"alias {w}"], "t") for k, w in enumerate(words)]
    schema = "id string, layer int, kind string, key string, label string, data string, active boolean, aliases array<string>, updated_at string"
    edges = [(f"c{r.randrange(6)}", "implemented_by", f"f{k}") for k in range(40)] + [("c0", "uses", "c1"), ("c1", "uses", "c3"), ("c4", "uses", "c0")]
    n, e = spark.createDataFrame(nodes, schema), spark.createDataFrame(edges, "source_id string, relation string, target_id string")
    queries = {"a": "pay the cart", "b": "alias user login", "c": "report_1", "d": "nothing here"}
    got = routing.contexts(spark.createDataFrame(list(queries.items()), "case_key string, query string"), n, e)
    files, concepts = got["files"].orderBy("case_key", "place").collect(), got["concepts"].orderBy("case_key", "place").collect()
    tasks = spark.createDataFrame([], "id string, title string, prompt string, summary string, created_at string")
    for case, query in queries.items():
        one = search.context(n, e, tasks, spark.createDataFrame([], "task_id string, concept_id string"), query)
        assert [x.id for x in concepts if x.case_key == case] == [x.id for x in one["concepts"].collect()]
        assert [x.path for x in files if x.case_key == case] == [x.path for x in one["files"].collect()]


def test_gram_index_equals_the_nested_loop(spark):
    r = random.Random(2)
    texts = [(k, "".join(r.choice("abAB é") for _ in range(r.randrange(40)))) for k in range(120)] + [(500, None), (501, ""), (502, "xyz" * 500)]
    patterns = ["ab", "ABA", "é a", "bab ", "zx", "xyzxyz", "q", "", "zzz", "aaaa", "Ab"]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(x,) for x in [*patterns, "ab", None]], "pattern string")
    want = sorted((k, x) for k, s in texts for x in patterns if len(x) >= 2 and s is not None and x.lower() in s.lower())
    found = grams.containing(t, p)
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, grams.containing(t, p, grams.index(t)).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = grams.containing(t, p)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_keywords_keep_their_order_and_limit(spark):
    files = spark.createDataFrame([("p", "c", "b.csv", '{"columns": ["x", " y ", ""], "sections": ["s"]}'), ("p", "c", "a.csv", '{"objects": ["o", "x"], "columns": ["z"]}'), ("p", "d", "a", "{}"), ("p", "e", "l", json.dumps({"sheets": ["w" * 200] + [f"k{k:03d}" for k in range(300)]}))], "project_id string, concept_key string, path string, metadata string")
    own = spark.createDataFrame([("p", "c", ["y", "first"])], "project_id string, concept_key string, keywords array<string>")
    got = {x.concept_key: x.keywords for x in semantic.concept_keywords(files, own).collect()}
    assert got["c"] == ["y", "first", "z", "o", "x", "s"] and "d" not in got and got["e"] == ["w" * 160] + [f"k{k:03d}" for k in range(149)]


def test_a_backfilled_log_replays_to_the_same_tables(spark, tmp_path):
    rows = [("1", "session_upsert", S), ("2", "task_created", S | {"task_id": "t1", "title": "One", "prompt": "p"}), ("3", "task_event", S | {"event_type": "read", "paths": ["a.py", "b.py"], "data": {"k": [1, "x"]}, "tool_name": "Read"}), ("4", "task_closed", {"task_id": "t1", "status": "failed", "summary": "s", "affected_concepts": [{"key": "pay", "label": "Pay"}]}), ("5", "task_event", S | {"event_type": "note", "paths": []}),
            ("6", "task_created", S | {"task_id": "t2", "title": "Two"}), ("7", "session_end", S), ("8", "task_created", S | {"task_id": "t3", "title": "Three"}), ("9", "session_upsert", S | {"external_session_id": "o"}), ("10", "session_end", S | {"external_session_id": "o"}), ("11", "session_upsert", S | {"external_session_id": "o"})]
    typed = layer3.typed(lines(spark, tmp_path, rows))
    state = layer3.merged(layer3.partials(layer3.active_lines(typed)))
    log = layer3.backfill(state)
    again = eventlog.parsed(eventlog.in_order(log, layer3.BACKFILL_ORDER))
    nothing = spark.createDataFrame([], "project_id string, key string")
    a, b = layer3.replay(typed, nothing, nothing), layer3.replay(layer3.typed(again), nothing, nothing, strict=True)
    flat = lambda got: rows_of(got | {"events": got["events"].drop("seq")})
    assert flat(a) == flat(b)
    assert layer3.backfill(state, again).count() == 0


def test_store_prunes_and_replaces(spark, small, tmp_path):
    nodes, edges = small
    s = store.GraphStore(spark, f"file://{tmp_path}/graph")
    s.write(nodes, edges)
    assert s.read("nodes", "p", 2).count() == 2 and "PartitionFilters: [isnotnull" in s.read("nodes", "p", 2)._jdf.queryExecution().toString()
    s.write(nodes.filter("layer = 2").limit(1), edges.filter("layer = 2"))
    assert s.read("nodes").count() == 6 and s.drop("p", 3) == 2 and s.read("nodes").count() == 5
    left = reports.reset_layer(nodes, edges, 2)
    s.write(nodes, edges)
    s.write(*left, whole=["p"])
    assert {r.layer for r in s.read("nodes").select("layer").distinct().collect()} == {1, 3} and {r.layer for r in s.read("edges").select("layer").distinct().collect()} == {1, 3}
    (tmp_path / "graph" / "writing").touch()
    with pytest.raises(ValueError, match="did not end"):
        s.read("nodes")
    s.write(nodes, edges)
    assert s.read("nodes", "p", 2).count() == 2
    spark.range(1).select(F.lit(99).alias("schema_version")).write.mode("overwrite").parquet(f"file://{tmp_path}/graph/meta")
    with pytest.raises(ValueError):
        s.read("nodes")


def test_settings_and_registry(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"ignore": ["tmp"], "context_files": 7}')
    got = store.settings(str(tmp_path / "s.json"), {"STRATALOOM_CONTEXT_FILES": "9", "STRATALOOM_IGNORE": "out"})
    assert got["context_files"] == 9 and {"tmp", "out", ".git"} <= set(got["ignore"])
    with pytest.raises(ValueError):
        store.settings(None, {"STRATALOOM_NONSENSE": "1"})
    df = spark.createDataFrame([("My App", "/a"), ("my app", "/b"), ("Other", "/c")], "name string, root string")
    ids = {r.root: r.project_id for r in store.project_ids(df).collect()}
    assert ids["/a"] == "my-app" and ids["/b"].startswith("my-app-") and len(ids["/b"]) == 15 and ids["/c"] == "other"
    later = {r.root: r.project_id for r in store.project_ids(df, spark.createDataFrame([("my-app", "/b"), ("kept", "/c")], "project_id string, root string")).collect()}
    assert later["/b"] == "my-app" and later["/a"].startswith("my-app-") and later["/c"] == "kept"  # what is registered keeps its id
    registry = spark.createDataFrame([("x", "X", "/a", "generic", "1", "1")], "project_id string, name string, root string, kind string, created_at string, updated_at string")
    seen = spark.createDataFrame([("x", "New", "/a", None, "5", 2), ("x", "Old", "/a", "video", "3", 1), ("y", None, "/q/r", None, "4", 3)], "project_id string, name string, root string, kind string, at string, seq int")
    assert sorted(map(tuple, store.upsert_projects(registry, seen).collect())) == [("x", "New", "/a", "generic", "1", "5"), ("y", "r", "/q/r", "generic", "4", "4")]
    with pytest.raises(ValueError):
        store.upsert_projects(registry, seen.withColumn("project_id", F.lit("z"))).collect()
    known = spark.createDataFrame([("x", "/a")], "project_id string, root string")
    assert store.conflicts(known, spark.createDataFrame([("y", "/a"), ("z", "/q")], "project_id string, root string")).first().project_id == "y"


def test_vault(spark, tmp_path):
    concepts = spark.createDataFrame([("pay", "Pay [x]"), ("shop", "Shop")], "key string, label string")
    files = spark.createDataFrame([("pay", "src/a b.py")], "key string, path string")
    relations = spark.createDataFrame([("pay", "uses", "shop")], "source string, relation string, target string")
    tasks = spark.createDataFrame([(f"t{k}", f"Task {k}", "done", f"2024-{k:02d}", "") for k in range(30)], "task string, title string, status string, created_at string, summary string")
    rows = vault.notes("proj", "/root", concepts, files, relations, tasks, tasks.select("task", F.lit("pay").alias("key")))
    got = {(r.folder, r.note.rsplit("-", 1)[0]): r.body for r in rows.collect()}
    body = got["concepts", "Pay x"]
    assert "src/a+b.py" in body or "src/a%20b.py" in body
    assert body.count("[[Task") == 20 and "uses [[Shop-" in body and "Task 29" in body and "Task 3-" not in body
    assert len(got) == 33 and ("", "index") in {(f, "index") for f, n in got if f == ""}
    for _ in range(2):
        vault.write(rows, f"file://{tmp_path}/vault")
    assert spark.read.text(f"file://{tmp_path}/vault").filter("folder = 'concepts'").select("note").distinct().count() == 2


def test_grammars():
    js = grammar.javascript("import a, {b} from './x'\nimport './y'; // import 'no'\nconst z = require(\"z/lib\"), q = import('./lazy')\nexport { t } from '@scope/p/sub'\nexport default class Foo {}\nlet s = 'import \"no\"'\nasync function bar() {}\n")
    assert [v for _, _, v in js.references] == ["./x", "./y", "z/lib", "./lazy", "@scope/p/sub"] and {n for _, n in js.symbols} >= {"Foo", "bar", "z", "s"}
    rs = grammar.rust("pub mod a;\nmod inline { }\nuse crate::b::{C, D as E};\nextern crate libc;\npub(crate) async fn run<'a>(x: &'a str) {}\nstruct S;")
    assert rs.references == [("imports", "rust_module", "a"), ("imports", "qualified", "crate::b::{C,D as E}")] and rs.external == ["libc"] and ("function", "run") in rs.symbols and ("struct", "S") in rs.symbols
    jv = grammar.java("package a.b;\nimport static a.b.C.*;\nimport x.Y;\n/* class No {} */ public class T extends U { Class k = T.class; }\nfun <A> g(x: A) {}")
    assert jv.package == "a.b" and [v for _, _, v in jv.references] == ["a.b.C.*", "x.Y"] and ("class", "T") in jv.symbols and ("class", "No") not in jv.symbols
    cc = grammar.c('#include "p.h"\n#include <vector>\nnamespace n { class K { void m() { } };\nint f(int a, char b[2]) { if (a) { g(); } return 0; }\nint decl(void);\n}')
    assert cc.references == [("includes", "relative", "p.h"), ("includes", "system", "vector")] and [n for k, n in cc.symbols if k == "function"] == ["f"] and ("type", "K") in cc.symbols
    assert grammar.csharp("using System.Text;\nnamespace A.B { public record struct P(int x); interface I {} }").external == ["System"]
    rb = grammar.ruby("require 'json'\nrequire_relative(\"../x\")\n# require 'no'\nclass A::B\n  def self.go!\n  end\nend")
    assert [(h, v) for _, h, v in rb.references] == [("module", "json"), ("relative", "../x")] and rb.symbols == [("class", "A::B"), ("function", "go!")]
    ph = grammar.php("<?php\nrequire_once('a.inc');\nuse App\\Models\\User;\nclass U { public function f($x) {} }")
    assert ph.references == [("imports", "relative", "a.inc")] and ph.external == ["App"] and ("function", "f") in ph.symbols
    assert grammar.swift("import Foundation\nfunc f(a: Int) {}\nstruct S {}").external == ["Foundation"]
    assert grammar.shell("source ./a.sh\n. 'b.sh'\nf() {\n}\nfunction g () {").references == [("sources", "relative", "./a.sh"), ("sources", "relative", "b.sh")]
    assert grammar.lua("local j = require 'cjson'\n--[[ require 'no' ]]\nfunction a.b.c(x) end").symbols == [("function", "a.b.c")]
    assert grammar.javascript('const a = /[/*]/;\nimport x from "y"\nconst b = 4 / 2 / 1; import z from "w"\nreturn /a"b/g').references == [("imports", "module", "y"), ("imports", "module", "w")]
    assert grammar.c("enum class E { A };\nenum F { B };").symbols == [("type", "E"), ("type", "F")]
    g = grammar.go('package m\nimport (\n\t"fmt"\n\tx "example.com/y"\n)\nimport "os"\ntype T struct{}\nfunc (t *T) Run() {}\n')
    assert g.package == "m" and [v for _, _, v in g.references] == ["fmt", "example.com/y", "os"] and g.symbols == [("type", "T"), ("function", "Run")]
    assert grammar.headings("# A b #\n####### no\n##x\n## C") == ["A b", "C"]
    assert list(grammar.links('[a](x.md "t") ![i](p.png) [[N#h|l]] [no] (y) [b](<>)'))[:3] == [("a", "x.md"), ("i", "p.png"), ("", "N")]


def test_candidates_of_a_suite_are_ranked_before_they_are_read(spark):
    """What reads the candidates, even twice, has no ranking in its plan."""
    cases = spark.createDataFrame([("c", "alpha")], "case_key string, query string")
    nodes = spark.createDataFrame([("f1", 1, "file", "src/alpha.py", "alpha.py", "{}", True, []), ("f2", 1, "file", "src/b.py", "b.py", "{}", True, [])], "id string, layer int, kind string, key string, label string, data string, active boolean, aliases array<string>")
    found = reports.candidates(cases, nodes, spark.createDataFrame([], "source_id string, relation string, target_id string"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("c", "filename-search", "src/alpha.py"), ("c", "full-scan", "src/alpha.py"), ("c", "full-scan", "src/b.py"), ("c", "routed", "src/alpha.py")]


def test_round_trip_reads_the_lines_of_both_replays_from_tables(spark, sf):
    """What the result reads is a state that is written: it derives no running task again."""
    got = replay_queries.backfill_round_trip(spark, sf)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
