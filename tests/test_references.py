"""Edges maintained from change sets against a full resolution of the same files."""

import random

import pytest
from pyspark.sql import functions as F

from strataloom.plans import references
from strataloom.sources import listing

FACTS = "project_id string, path string, references array<struct<relation:string,how:string,value:string>>, external array<string>, metadata string"
FOLDERS = ["", "src/", "src/core/", "docs/", "lib/core/"]
NAMES = ["a.py", "b.py", "test_a.py", "a.md", "b.md", "index.ts", "util.ts", "util.test.ts", "main.rs", "mod.rs", "Core.java", "core.go", "core_test.go", "go.mod"]
REFERENCES = [
    ("imports", "python", "0|a|a"), ("imports", "python", "0|core.b|core"), ("imports", "python", "1|b|"), ("imports", "python", "2|core|"), ("references", "document", "a"), ("references", "document", "../src/b.md#x"),
    ("references", "document", "gone/a.md"), ("references", "document", "https://a/b.md"), ("references", "document", "#top"), ("imports", "module:typescript", "./util"), ("imports", "module:typescript", "../core"),
    ("imports", "module:typescript", "@scope/pkg/x"), ("imports", "qualified:java", "org.x.Core"), ("imports", "qualified:rust", "crate::main::run"), ("imports", "qualified:rust", "serde::de"), ("imports", "rust_module", "mod"),
    ("imports", "go", "m/src/core"), ("imports", "go", "n/lib/core"), ("imports", "go", "fmt"), ("imports", "system", "stdio.h"), ("references", "structured", "a"), ("references", "relative", "b.py"),
]


def rows(spark, tree):
    flat = [(p, path, refs, ext, '{"module":"%s"}' % mod if path == "go.mod" else "{}") for (p, path), (refs, ext, mod) in tree.items()]
    return spark.createDataFrame(flat, FACTS).coalesce(1)


def drawn(rng):
    return [rng.sample(REFERENCES, rng.randint(0, 6)), rng.sample(["numpy", "left-pad"], rng.randint(0, 1)), rng.choice("mn")]


def contents(df):
    return sorted(map(tuple, df.collect()), key=repr)


def changes(spark, before, after):
    new = [(*k, "new") for k in after if k not in before]
    gone = [(*k, "deleted") for k in before if k not in after]
    return spark.createDataFrame(new + gone + [(*k, "changed") for k in after if k in before and after[k] != before[k]], "project_id string, path string, change string")


@pytest.mark.parametrize("seed", range(2))
def test_differences_give_what_a_full_scan_gives(spark, seed):
    rng = random.Random(seed)
    keys = [(p, f + n) for p in ("x", "y") for f in FOLDERS for n in NAMES]
    tree = {k: drawn(rng) for k in rng.sample(keys, 60)} | {("x", "go.mod"): [[], [], "m"]}
    held = references.state(rows(spark, tree)).stored()
    for _ in range(2):
        after = {k: v for k, v in tree.items() if rng.random() > 0.15}
        after |= {k: drawn(rng) for k in rng.sample(keys, 8)}
        diff = changes(spark, tree, after)
        fresh = rows(spark, {k: v for k, v in after.items() if tree.get(k) != v})
        was = set(contents(held.edges()))
        held, said = references.update(held, fresh, diff)
        whole = references.state(rows(spark, after))
        want = {name: contents(getattr(whole, name)) for name in ("refs", "tries", "names", "modules", "links")}
        assert {name: contents(getattr(held, name)) for name in want} == want
        now = {(*r[:3], r[5]) for r in want["links"] if r[1] != r[5]}
        assert contents(held.edges()) == sorted(now, key=repr)
        assert set(contents(said.inserted.select(*references.EDGE))) == now - was and set(contents(said.deleted.select(*references.EDGE))) == was - now
        linked = {r[:5] for r in want["links"]}
        loose = {}
        for r in want["refs"]:
            if r[5] and r[:5] not in linked:
                loose.setdefault(r[:2], set()).add(r[5])
        assert {tuple(r[:2]): set(r[2]) for r in contents(held.packages())} == loose
        tree = after


def test_only_files_with_another_answer_are_resolved_again(spark):
    tree = {("p", f"docs/{k}.md"): [[("references", "document", f"{k + 1}.md")], [], ""] for k in range(20)}
    tree |= {("p", "docs/loose.md"): [[("references", "document", "elsewhere/spec.md")], [], ""], ("p", "old/spec.md"): [[], [], ""]}
    held = references.state(rows(spark, tree)).stored()
    assert ("p", "docs/loose.md", "references", "old/spec.md") in contents(held.edges())
    more = tree | {("p", "new/spec.md"): [[], [], ""]}
    del more["p", "docs/7.md"]
    fresh = rows(spark, {("p", "new/spec.md"): more["p", "new/spec.md"]})
    _, said = references.update(held, fresh, changes(spark, tree, more))
    # A second file of the name makes it ambiguous; the neighbour of the deleted file loses its edge.
    assert {r.source for r in said.sources.collect()} == {"docs/6.md", "docs/loose.md", "new/spec.md"}
    assert {r.source for r in said.deleted.collect()} == {"docs/6.md", "docs/7.md", "docs/loose.md"} and said.inserted.count() == 0


def test_nothing_changes_without_changes(spark):
    tree = {("p", "a.md"): [[("references", "document", "b.md")], ["x"], ""], ("p", "b.md"): [[], [], ""]}
    held = references.state(rows(spark, tree)).stored()
    now, said = references.update(held, rows(spark, tree).limit(0), changes(spark, tree, tree))
    assert contents(now.links) == contents(held.links) and said.sources.count() == said.deleted.count() == said.inserted.count() == 0
    empty = references.state(rows(spark, tree).limit(0))
    assert empty.links.count() == 0 and empty.packages().count() == 0


def test_change_sets_of_listings_drive_the_update(spark):
    tree = {("p", "a.md"): [[("references", "document", "b.md")], [], ""]}
    now = tree | {("p", "b.md"): [[], [], ""]}
    listed = lambda t: spark.createDataFrame([(*k, len(v[0])) for k, v in t.items()], "project_id string, path string, size long")
    found = listing.change_set(listed(now), listed(tree), ["project_id", "path"], ["size"])
    _, said = references.update(references.state(rows(spark, tree)), rows(spark, {("p", "b.md"): now["p", "b.md"]}), found)
    assert [tuple(r) for r in said.inserted.select("source", "target").collect()] == [("a.md", "b.md")]
    assert said.inserted.filter(F.col("relation") != "references").count() == 0


def test_references_of_a_folder_that_say_the_same_are_one_question(spark):
    """A hundred notes that name one file are resolved by one row, before and after the file goes."""
    tree = {("p", f"notes/{k}.md"): [[("references", "document", "../parts/x.py")], [], ""] for k in range(100)} | {("p", "parts/x.py"): [[], [], ""]}
    held = references.state(rows(spark, tree)).stored()
    assert [r.targets for r in held.answers.collect()] == [["parts/x.py"]] and held.edges().count() == 100
    less = {k: v for k, v in tree.items() if k[1] != "parts/x.py"}
    after, said = references.update(held, rows(spark, less).limit(0), changes(spark, tree, less))
    assert [r.targets for r in after.answers.collect()] == [[]] and {r.change for r in said.edges.collect()} == {"deleted"} and said.edges.count() == 100
