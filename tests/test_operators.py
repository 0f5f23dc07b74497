"""Operators on small tables: search terms, the log, overlays, evaluation, resolution."""

import random

from pyspark.sql import functions as F

from strataloom.functions import scalars as S
from strataloom.operators import evaluate, graph, overlay, resolve, tasklog


def test_terms_of_columns_equal_terms_of_strings(spark):
    queries = ["修改会员升级和支付逻辑", "fix src/pay.py and 会员 now", "  ", "a bb ccc-dd", "支付"]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select("q", S.search_terms_column(F.col("q")).alias("t")).collect()
    assert {r.q: r.t for r in rows} == {q: S.search_terms(q) for q in queries}


def test_paths_and_scalars(spark):
    df = spark.createDataFrame([("a/./b/../c.py",), ("../x",), ("src/payment/test_Service.py",), (".env",), ("docs/guide.md",)], "p string")
    p = F.col("p")
    got = {r.p: r for r in df.select("p", S.normalize_path(p).alias("n"), S.path_relation(p).alias("r"), S.language(p).alias("l"), S.concept_name(p, F.lit("proj")).alias("c")).collect()}
    assert got["a/./b/../c.py"].n == "a/c.py" and got["../x"].n is None
    assert got["src/payment/test_Service.py"].r == "tested_by" and got["src/payment/test_Service.py"].c == "payment"
    assert got["docs/guide.md"].r == "documented_by" and got["docs/guide.md"].c == "guide" and got["docs/guide.md"].l == "markdown"
    one = spark.range(1).select(S.tool_class(F.lit("Bash"), F.lit("cd x && pytest -q")).alias("a"), S.tool_class(F.lit("apply_patch"), F.lit("")).alias("b"), S.end_status(F.lit(None), F.lit("aborted"), F.lit("user")).alias("c"), S.end_status(F.lit(""), F.lit("error"), F.lit(None)).alias("d"), S.patch_paths(F.lit("*** Update File: a/b.py\n*** Add File: c.py")).alias("e"), S.session_key(F.lit("x"), F.lit("1")).alias("f")).first()
    assert tuple(one) == ("test", "modify", "cancelled", "failed", ["a/b.py", "c.py"], "x:1")


def test_active_task_equals_a_sequential_fold(spark):
    r = random.Random(4)
    rows, want, state = [], {}, {}
    for seq in range(600):
        s, kind = r.randrange(5), r.choice(["start", "stop", None, None])
        started, active = state.get(s, (None, None))
        task = seq if kind == "start" else r.choice([started, 99_999]) if kind == "stop" else None
        if kind == "start":
            started = active = seq
        elif kind == "stop" and task is not None and task == active:
            active = None
        state[s] = (started, active)
        rows.append((s, seq, kind, task))
        want[seq] = active
    got = tasklog.active_task(spark.createDataFrame(rows, "session int, seq int, marker string, task int")).collect()
    assert {x.seq: x.active_task for x in got} == want


def test_replay_twice_is_once(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "event_id string, seq int")
    first = tasklog.unapplied(e, e.limit(0))
    assert {(r.event_id, r.seq) for r in first.collect()} == {("a", 1), ("b", 3)}
    assert tasklog.unapplied(e, first).count() == 0


def test_renames_leave_the_last_and_merges_chain(spark):
    log = spark.createDataFrame([(1, "rename_concept", "m", "", "", "A"), (2, "rename_concept", "m", "", "", "B"), (3, "add_alias", "m", "", "", "x"), (4, "add_alias", "m", "", "", "y"), (5, "add_alias", "m", "", "", "x"), (6, "reject_edge", "m", "depends_on", "p", ""), (7, "accept_edge", "m", "depends_on", "p", "")], "seq int, action string, subject_key string, relation string, object_key string, value string")
    got = {(r.action, r.value, r.order_seq) for r in overlay.last_per_slot(log).collect()}
    assert got == {("rename_concept", "B", 2), ("add_alias", "x", 3), ("add_alias", "y", 4), ("accept_edge", "", 7)}
    assert overlay.merge_map([("a", "b"), ("b", "c"), ("c", "a")]) == {"a": "c", "b": "c"}


def test_gated_comparison(spark):
    rows = [("m", "base", 10_000, 1.0, True), ("m", "routed", 2_500, 1.0, True), ("low", "base", 10, 0.94, True), ("low", "routed", 1, 1.0, True), ("unknown", "base", 10, 1.0, None), ("unknown", "routed", 1, 1.0, True)]
    got = evaluate.compare(spark.createDataFrame(rows, "case_key string, mode string, tokens long, recall double, success boolean"), "base", "routed", observed=True).first()
    assert (got.pairs, got.eligible, got.reduction) == (3, 1, 0.75)


def test_latest_run_keeps_the_first_of_equal_times(spark):
    rows = [("c", "k", "m", 1, 5), ("c", "k", "m", 2, 5), ("c", "k", "m", 3, 4)]
    assert evaluate.latest_runs(spark.createDataFrame(rows, "case_key string, run_kind string, mode string, seq int, created_at int")).first().seq == 1


def test_upsert_keeps_creation_times(spark):
    old = spark.createDataFrame([("a", "1", 10), ("b", "2", 10)], "k string, v string, created_at int")
    new = spark.createDataFrame([("a", "9", 99), ("c", "3", 99)], "k string, v string, created_at int")
    assert {tuple(r) for r in graph.upsert(old, new, ["k"]).collect()} == {("a", "9", 10), ("b", "2", 10), ("c", "3", 99)}


def test_resolution(spark):
    paths = spark.createDataFrame([("src/a/index.ts",), ("src/pkg/__init__.py",), ("lib/pkg.py",), ("src/x/Pay.java",)], "path string")
    refs = spark.createDataFrame([("src/b.ts", "./a"), ("src/b.ts", "https://x/y"), ("src/b.ts", "../../up")], "source string, reference string")
    got = {r.reference: r.target for r in resolve.first_match(refs, paths, [".ts"]).collect()}
    assert got == {"./a": "src/a/index.ts", "https://x/y": None, "../../up": None}
    mods = spark.createDataFrame([("main.py", "pkg", 0)], "source string, module string, level int")
    assert {r.target for r in resolve.python_modules(mods, paths).collect()} == {"src/pkg/__init__.py", "lib/pkg.py"}
    names = spark.createDataFrame([("m", "com.shop.Pay"), ("m", "com.none.Other")], "source string, name string")
    assert {r.name: r.target for r in resolve.by_unique_stem(names, paths).collect()} == {"com.shop.Pay": "src/x/Pay.java", "com.none.Other": None}
