"""Listings, kinds of projects, line ends of records and small operators that plans call."""

from pyspark.sql import functions as F

from strataloom.functions import scalars as S
from strataloom.sources import eventlog, extract, listing, rules, store


def test_names_are_ignored_below_the_root_only(spark, tmp_path):
    root = tmp_path / "build" / "proj"
    for name in ("src/a.py", "build/b.py", "x y.py", ".DS_Store", "node_modules/q/c.js"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    got = listing.stored_files(spark, f"file://{root}")
    assert {r.path for r in got.select("path").collect()} == {"src/a.py", "x y.py"}
    assert got.select(store.content_digest().alias("d")).distinct().count() == 1
    assert {r.t for r in got.select(listing.text_content(F.col("content"), F.col("size")).alias("t")).collect()} == {"x"}


def test_kind_of_a_project(spark):
    kind = lambda *paths: listing.project_kind(spark.createDataFrame([(p,) for p in paths], "path string")).first().kind
    assert kind("go.mod", "a.mp4") == "software" and kind("a.mp4", "b.mov", "c.WAV") == "video" and kind(*[f"{k}.md" for k in range(5)]) == "writing" and kind("a.md") == "generic"


def test_records_end_at_line_feeds_only():
    out = extract.Facts()
    extract.jsonl_file("x.jsonl", '{"a": "1\x85 2"}\r\n{"a": "\u2028"}\n{"b": 1}\n', out)
    assert out.metadata["record_count"] == 3 and out.metadata["invalid_count"] == 0 and out.metadata["key_frequencies"] == {"a": 2, "b": 1}


def test_dependents_and_health(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "d")], "source string, target string")
    assert {r.path for r in listing.dependents(edges, spark.createDataFrame([("b",)], "path string")).collect()} == {"a", "c"}
    nodes = spark.createDataFrame([("1",), ("1",), ("2",)], "id string")
    links = spark.createDataFrame([("2", 0.5), ("3", 1.5)], "target_id string, confidence double")
    assert eventlog.health(nodes, links).first().asDict() == {"repeated_ids": 1, "loose_targets": 1, "odd_confidences": 1}


def test_paths_of_events(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    at = lambda p: one(S.event_path(F.lit(p), F.lit("/r/p")))
    assert at("/r/p/a/../b.py") == "b.py" and at("a\\b") == "a/b" and at("/r/px/a") is None and at("../a") is None
    assert one(S.loose_path(F.lit(".\\..\\x/y"))) == "x/y" and one(S.clean_title(F.lit("  a  b "))) == "a b" and one(S.clean_title(F.lit(" "))) == S.fixed.UNNAMED


def test_values_that_name_files():
    yes = [("inputPath", "x"), ("k", "a.json"), ("k", "/A.YML"), ("k", "./x"), ("k", "../x"), ("HREF", "y"), ("data_file", "z"), ("k", "a b.nc4")]
    no = [("k", "a.exe"), ("k", ".json"), ("k", "json"), ("k", "a\nb.json"), ("pathway", "x"), ("k", "")]
    assert all(rules.names_path(*x) for x in yes) and not any(rules.names_path(*x) for x in no)
