"""The five-file project: counts, edges, concepts, incremental scans; and format samples."""

import io
import json
import os
import sqlite3
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import search
from strataloom.plans import project, references
from strataloom.sources import extract, listing, provider

FILES = {
    "pyproject.toml": '[project]\nname = "shop"\nversion = "1"\n',
    "src/payment/service.py": "def charge(amount):\n    return amount\n",
    "src/membership/upgrade.py": "from src.payment.service import charge\n\ndef upgrade():\n    return charge(1)\n",
    "tests/test_upgrade.py": "from src.membership.upgrade import upgrade\n\ndef test_it():\n    assert upgrade()\n",
    "docs/membership.md": "# 会员升级\n\nSee [payment](../src/payment/service.py).\n",
}


def table(spark, files, stamp=1):
    rows = [("shop", p, stamp, len(c.encode() if isinstance(c, str) else c), bytearray(c.encode() if isinstance(c, str) else c)) for p, c in files.items()]
    return spark.createDataFrame(rows, "project_id string, path string, mtime_ns long, size long, content binary")


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    """One scan, written once, as all tests read it."""
    top = str(tmp_path_factory.mktemp("graph"))
    g, changes = project.scan(table(spark, FILES))
    assert changes.count() == 5
    g.facts.write.parquet(top + "/facts")
    facts = spark.read.parquet(top + "/facts")
    g = project.build(facts)
    g.file_edges.write.parquet(top + "/file_edges")
    g.nodes.write.parquet(top + "/nodes")
    g.edges.write.parquet(top + "/edges")
    return project.Graph(spark.read.parquet(top + "/nodes"), spark.read.parquet(top + "/edges"), facts, spark.read.parquet(top + "/file_edges"))


def test_graph_of_the_small_project(scanned):
    g = scanned
    edges = {(r.source, r.relation, r.target) for r in g.file_edges.collect()}
    assert ("src/membership/upgrade.py", "imports", "src/payment/service.py") in edges
    assert ("tests/test_upgrade.py", "imports", "src/membership/upgrade.py") in edges
    assert ("tests/test_upgrade.py", "tests", "src/membership/upgrade.py") in edges
    assert ("docs/membership.md", "references", "src/payment/service.py") in edges
    nodes = g.nodes.collect()
    assert sum(n.kind == "file" for n in nodes) == 5
    concepts = {n.key: n.label for n in nodes if n.kind == "concept"}
    assert concepts["membership"] == "会员升级" and "payment" in concepts
    ids = {n.id: n for n in nodes}
    between = [e.relation for e in g.edges.filter("layer = 2").collect() if ids[e.source_id].key == "membership" and ids[e.target_id].key == "payment" and ids[e.target_id].kind == "concept"]
    assert between == ["depends_on"]
    spark = g.nodes.sparkSession
    tasks = spark.createDataFrame([("t", "Fix it", "completed", "2024", "")], "task string, title string, status string, created_at string, summary string")
    notes = [r.body for r in project.vault_notes(g, "shop", "/shop", tasks, spark.createDataFrame([("t", "membership")], "task string, key string")).collect()]
    own = next(b for b in notes if b.startswith("# 会员升级"))
    assert "src/membership/upgrade.py" in own and "depends_on [[" in own and "Fix it" in own
    data = {n.key: json.loads(n.data) for n in nodes if n.kind == "concept"}
    assert data["membership"]["active"] and data["membership"]["roles"] and isinstance(data["membership"]["keywords"], list)


def test_concepts_without_files_stay_inactive(spark, scanned):
    left = {p: c for p, c in FILES.items() if not p.startswith("src/payment/")}
    g, _ = project.scan(table(spark, left), scanned.facts, before=scanned.nodes)
    data = {n.key: json.loads(n.data) for n in g.nodes.filter("kind = 'concept'").collect()}
    assert data["payment"]["active"] is False and data["payment"]["file_count"] == 0 and data["membership"]["active"]


def test_search_reaches_the_feature(spark, scanned):
    g = scanned
    nodes = g.nodes.withColumns({"active": F.lit(True), "aliases": F.array().cast("array<string>"), "updated_at": F.lit(0)})
    tasks = spark.createDataFrame([], "id string, title string, prompt string, summary string, created_at string")
    links = spark.createDataFrame([], "task_id string, concept_id string")
    got = search.context(nodes, g.edges.select("source_id", "relation", "target_id"), tasks, links, "修改会员升级和支付逻辑")
    paths = {r.path for r in got["files"].collect()}
    assert {"src/membership/upgrade.py", "src/payment/service.py", "docs/membership.md"} <= paths
    assert "会员升级" in search.render(got)


def test_second_scan_reads_nothing(spark, scanned):
    files, before = table(spark, FILES), scanned.facts
    _, changes = project.scan(files, before)
    assert changes.count() == 0
    more = dict(FILES) | {"docs/membership.md": "# 会员升级\n\n[later](later.md)\n"}
    del more["tests/test_upgrade.py"]
    _, changes = project.scan(table(spark, more), before)
    assert {(r.path, r.change) for r in changes.collect()} == {("docs/membership.md", "changed"), ("tests/test_upgrade.py", "deleted")}


def test_scan_by_differences_gives_the_whole_graph(spark, scanned):
    more = dict(FILES) | {"docs/membership.md": "# 会员升级\n\n[later](later.md)\n", "docs/later.md": "# Later\n\n[upgrade](../src/membership/upgrade.py)\n", "src/membership/extra.py": "import numpy\nimport src.payment.refund\n"}
    del more["src/payment/service.py"]
    files = table(spark, more)
    step, changes = project.scan(files, scanned.facts, state=references.state(scanned.facts).stored())
    whole, _ = project.scan(files)
    assert changes.count() == 4
    nodes = lambda g: sorted((n.kind, n.key, n.label, n.data) for n in g.nodes.collect())
    assert nodes(step) == nodes(whole)
    edges = lambda g: sorted((e.id, e.relation, e.data, e.confidence) for e in g.edges.collect())
    assert edges(step) == edges(whole)
    found = {tuple(r)[1:] for r in step.references.edges().collect()}
    assert ("docs/membership.md", "references", "docs/later.md") in found and not any(target == "src/payment/service.py" for _, _, target in found)


def test_provider_is_clamped_and_unknown_ends_go(spark, scanned):
    g = scanned
    concepts = spark.createDataFrame([("shop", "billing", "Billing", ["src/payment/service.py", "nowhere.py"], 1.7)], "project_id string, key string, label string, files array<string>, confidence double")
    relations = spark.createDataFrame([("shop", "billing", "depends_on", "membership", 0.4), ("shop", "billing", "depends_on", "unknown", 0.4)], "project_id string, source string, relation string, target string, confidence double")
    out = project.merge_provider(g, concepts, relations)
    new = out.edges.filter("source = 'external-semantic-provider'").collect()
    assert len(new) == 2 and max(e.confidence for e in new) <= 1.0


ANSWERING = """
import json, sys
q = json.load(sys.stdin)
assert q["schema_version"] == 1 and q["project"]["id"] == "shop" and q["physical_edges"]
assert all({"key", "label", "data"} <= set(c) for c in q["concepts"])
print(json.dumps({"concepts": [
    {"key": "Billing Core", "label": "old"},
    {"key": "Billing Core", "label": "Billing", "confidence": 7, "files": ["src/payment/service.py", "nowhere.py"], "data": {"team": "a"}},
    {"key": "", "label": "none"}, "no object",
], "relations": [{"from": "Billing Core", "to": q["concepts"][0]["key"], "evidence": ["x"]}, {"from": "Billing Core", "to": "unknown"}, {"from": "", "to": "y"}]}))
"""


def test_provider_is_asked(spark, scanned, tmp_path):
    program = tmp_path / "provider.py"
    program.write_text(ANSWERING)
    projects = spark.createDataFrame([("shop", "Shop", str(tmp_path), "software"), ("empty", "No files", "/nowhere", "generic")], "project_id string, name string, root string, kind string")
    out = project.ask_provider(scanned, projects, f"{sys.executable} {program}")
    node = [n for n in out.nodes.collect() if n.source == "external-semantic-provider"]
    assert [(n.label, n.confidence, json.loads(n.data)) for n in node] == [("Billing", 1.0, {"active": True, "provider_data": {"team": "a"}})]
    edges = {e.relation: (e.confidence, json.loads(e.data)) for e in out.edges.collect() if e.source == "external-semantic-provider"}
    assert edges == {"implemented_by": (1.0, {"path": "src/payment/service.py"}), "related_to": (0.7, {"evidence": ["x"]})}


@pytest.mark.parametrize("code", ["raise SystemExit(3)", "print('[1]')", "print('{')", "pass", "import time; time.sleep(60)", None])
def test_failing_providers_answer_nothing(code, tmp_path):
    program = tmp_path / "p.py"
    program.write_text(code or "")
    command = "no-such-program" if code is None else f"{sys.executable} {program}"
    pieces = iter([(0, '{"id":"p","root":"/nowhere"}'), *[(2, json.dumps({"n": "x" * 1000}))] * 500])
    assert provider.ask(command, pieces, 3.0) is None and next(pieces, None) is None


def test_provider_that_reads_nothing_still_answers(tmp_path):
    program = tmp_path / "p.py"
    program.write_text("print('{}')")
    assert provider.ask(f"{sys.executable} {program}", iter([(0, '{"id":"p"}'), *[(1, json.dumps("x" * 1000))] * 500])).strip() == "{}"


def test_text_files_and_roots(tmp_path):
    assert extract.text_reason("a/x.py", b"\0") is None and extract.text_reason("Makefile", b"\0") is None
    assert extract.text_reason("a.bin", b"x\0") == "binary file" and extract.text_reason("a.bin", b"x") is None
    assert extract.text_reason("x.py", b" " * (extract.MAX_TEXT + 1)) == "the file is over its budget"
    assert extract.extract("x.py", b"\xff\xfe").warnings == ["not UTF-8"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("x")
    assert listing.project_root(str(tmp_path / "d" / "f.txt")) == os.path.realpath(tmp_path / "d")
    with pytest.raises(FileNotFoundError):
        listing.project_root(str(tmp_path / "gone"))


def test_installed_plugins():
    class Reader:
        extractor_id, extractor_version, priority = "own", 2, 5

        def read(self, path, content, out):
            out.roles.append("own")
            return True

    class Point:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    found = [Point("class", Reader), Point("factory", lambda: [Reader(), "no plug-in"]), Point("tuple", ("t", "1", 0, Reader().read)), Point("broken", ValueError("bad")), Point("nothing", 3)]
    plugins, warnings = extract.installed_plugins(found=found)
    assert [p[:3] for p in plugins] == [("own", "2", 5), ("own", "2", 5), ("t", "1", 0)] and warnings == ["broken: bad"]
    assert extract.extract("x.md", b"# T", plugins[:1]).roles[0] == "own"
    assert extract.installed_plugins()[1] == []


def test_format_samples():
    f = extract.extract("q.sql", b"INSERT INTO report SELECT * FROM sales JOIN customer ON 1=1;")
    assert set(f.metadata["read_tables"]) == {"sales", "customer"} and f.metadata["write_tables"] == ["report"]
    f = extract.extract("a.csv", b"id,name,score\n1,a,2.5\n2,b,3\n")
    assert f.metadata["column_count"] == 3 and f.metadata["row_count"] == 2
    f = extract.extract("a.xml", b"<r><item/><item href='x.json'/></r>")
    assert f.metadata["element_counts"]["item"] == 2 and ("references", "structured", "x.json") in f.references
    for name, text in (("a.json", '{"input": "../data/source.csv"}'), ("a.yaml", "input: ../data/source.csv\n")):
        assert ("references", "structured", "../data/source.csv") in extract.extract(name, text.encode()).references
    assert "database" in extract.extract("a.toml", b"[database]\nx = 1\n").metadata["sections"]
    assert extract.extract("a.ini", b"[service]\nk=v\n").metadata["sections"] == ["service"]
    nb = {"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "import os"}], "metadata": {}}
    assert extract.extract("n.ipynb", json.dumps(nb).encode()).metadata["cell_count"] == 2
    buf = io.BytesIO()
    np.save(buf, np.zeros((2, 3)))
    assert extract.extract("x.npy", buf.getvalue()).metadata["shape"] == [2, 3]
    buf = io.BytesIO()
    np.savez(buf, x=np.zeros(2), y=np.zeros(3))
    assert extract.extract("x.npz", buf.getvalue()).metadata["array_count"] == 2
    assert extract.extract("x.parquet", b"PAR1stubPAR1").warnings
    assert ("includes", "relative:c", "../include/pay.h") in extract.extract("m.cpp", b'#include "../include/pay.h"\n').references
    assert ("imports", "rust_module:rust", "payment") in extract.extract("lib.rs", b"mod payment;\n").references


def test_budgets_and_failures_are_warnings():
    out = extract.Facts()
    extract.csv_file("a.csv", "a,b\n" + "x" * 100 + ",1\n" + "c,d\n" * 30, out, 64, 128)
    assert out.metadata["oversized_lines"] >= 1 and out.metadata["budget_exhausted"]
    assert extract.extract("bad.json", b"{").warnings
    assert extract.extract("x.h5", b"nothing").warnings
    broken = [("p", "1", 5, lambda path, content, facts: 1 / 0)]
    assert any("p:" in w for w in extract.extract("a.md", b"# t", broken).warnings)
    assert extract.signature() != extract.signature(broken) and extract.signature(broken) == extract.signature(broken)


def test_sqlite_and_xlsx(tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute("create table t(a, b)")
    con.execute("create view v as select a from t")
    con.execute("create index i on t(a)")
    con.commit()
    con.close()
    f = extract.extract("a.db", (tmp_path / "a.db").read_bytes())
    assert f.metadata["object_counts"]["table"] == 1 and ("index:i", "attached_to", "table:t") in f.relations
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Inputs" r:id="r1"/><sheet name="Out" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'
        z.writestr("xl/worksheets/s1.xml", sheet.format(""))
        z.writestr("xl/worksheets/s2.xml", sheet.format("<row><c><f>Inputs!A1+1</f></c><c><f>SUM('Inputs'!A1:A3)</f></c></row>"))
    f = extract.extract("b.xlsx", buf.getvalue())
    assert f.resources[("worksheet", "sheet:Out")][1]["formula_sources"] == {"Inputs": 2}
    assert ("sheet:Out", "formula_depends_on", "sheet:Inputs") in f.relations


def test_go_packages_need_one_file(spark):
    files = {"go.mod": "module example.com/m\n", "main.go": 'package main\n\nimport (\n\t"example.com/m/one"\n\t"example.com/m/two"\n)\n', "one/a.go": "package one\n", "two/a.go": "package two\n", "two/b.go": "package two\n"}
    g, _ = project.scan(table(spark, files))
    assert {(r.source, r.target) for r in g.file_edges.collect()} == {("main.go", "one/a.go")}


def test_corrections_survive_a_scan(spark):
    """A renamed, aliased and merged concept, a mapped file and a rejected edge stand after the files are scanned again."""
    rows = [("rename_concept", "membership", "", "", "Members"), ("add_alias", "membership", "", "", "club"), ("create_concept", "billing", "", "", "Billing"), ("merge_concept", "payment", "", "billing", ""), ("map_file", "billing", "", "docs/membership.md", ""), ("reject_edge", "membership", "depends_on", "billing", "")]
    log = spark.createDataFrame([("shop", k, *r) for k, r in enumerate(rows)], "project_id string, seq int, action string, subject_key string, relation string, object_key string, value string")
    facts = project.scan(table(spark, FILES))[0].facts
    facts = spark.createDataFrame(facts.collect(), facts.schema)
    first = project.apply_corrections(project.build(facts), log)
    more = dict(FILES) | {"src/payment/refund.py": "def refund():\n    return 0\n"}
    for g in (first, project.scan(table(spark, more), facts, corrections=log)[0]):
        nodes = {r.key: r for r in g.nodes.filter("kind = 'concept'").collect()}
        assert nodes["membership"].label == "Members" and json.loads(json.loads(nodes["membership"].data)["aliases"]) == ["club"] and nodes["membership"].source == "human-overlay"
        assert json.loads(nodes["payment"].data)["merged_into"] == "billing" and json.loads(nodes["payment"].data)["active"] == "false"
        ids = {r.id: r.key for r in g.nodes.collect()}
        edges = {(ids[r.source_id], r.relation, ids[r.target_id]): r for r in g.edges.filter("layer = 2").collect()}
        assert ("membership", "depends_on", "billing") not in edges and ("payment", "merged_into", "billing") in edges
        assert edges["billing", "implemented_by", "docs/membership.md"].confidence == 1.0 and ("billing", "implemented_by", "src/payment/service.py") in edges
    assert len([k for k in edges if k[0] == "billing" and k[2].startswith("src/payment/")]) == 2


def test_unresolved_imports_are_external(spark):
    files = {"a.js": "import x from 'react'\nimport {y} from '@org/lib/sub'\nimport z from './b'\n", "b.js": "", "m.py": "import os, b2.c\n", "T.java": "import org.none.Thing;\n", "c.c": "#include <vector>\n", "Cargo.rs": "use serde::Serialize;\nuse crate::x::Y;\n"}
    g, _ = project.scan(table(spark, files))
    got = {r.key: json.loads(r.data).get("external") for r in g.nodes.filter("kind = 'file'").collect()}
    assert got == {"a.js": ["@org/lib", "react"], "b.js": None, "m.py": ["b2", "os"], "T.java": ["org"], "c.c": ["vector"], "Cargo.rs": ["serde"]}


def test_tests_meet_files_of_their_own_project(spark):
    rows = [("p1", "src/x.py"), ("p1", "tests/a/b/test_x.py"), ("p2", "tests/a/b/x.py")]
    df = spark.createDataFrame([(p, f, 1, 0, bytearray()) for p, f in rows], "project_id string, path string, mtime_ns long, size long, content binary")
    g, _ = project.scan(df)
    assert {(r.project_id, r.source, r.target) for r in g.file_edges.collect()} == {("p1", "tests/a/b/test_x.py", "src/x.py")}


def test_large_and_broken_tables_are_read():
    big = b"id,name\n" + b"1,a\n" * (5 << 18) + b"\xff,b\n"
    f = extract.extract("a.csv", big)
    assert len(big) > extract.MAX_TEXT and f.metadata["column_count"] == 2 and f.metadata["row_count"] == 100_000
    assert extract.extract("a.txt.json", b"[" + b"1," * (3 << 20) + b"1]").warnings
