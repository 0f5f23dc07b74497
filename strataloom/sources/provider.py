"""An external semantic provider: a program that reads a project as one JSON document and answers with concepts and relations.

The request is an object with schema_version, project, concepts and physical_edges, the answer one with concepts (key, label,
confidence, files, data) and relations (from, to, relation, confidence, evidence). Rows sorted by project are written to the
program's input as they arrive, so a project of any size is never one value; since the protocol wants one document, one process
serves one project, and projects run side by side. Whatever fails (no such program, an exit code, a timeout, an answer that is no
JSON object) gives no rows and never stops a scan. A project is asked again if its task is.
"""

from __future__ import annotations

import json
import os
import shlex
import subprocess
import threading
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S

EDGE_LIMIT = 5000  # physical edges of a request, by the protocol
TIMEOUT = 120.0
CONFIDENCE = 0.7  # where the answer names none

# Items are read one by one, so one that is no object spoils no other.
ANSWER_DDL = "concepts array<string>, relations array<string>"
CONCEPT_DDL = "key string, label string, confidence string, files array<string>, data string"
RELATION_DDL = "`from` string, `to` string, relation string, confidence string, evidence string"


def requests(nodes: DataFrame, edges: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, part, key, item): the JSON pieces of each request; projects(project_id, name, root, kind)."""
    own = nodes.join(projects.select("project_id"), "project_id", "left_semi")
    head = projects.select("project_id", F.lit(0).alias("part"), F.lit("").alias("key"), F.to_json(F.struct(F.col("project_id").alias("id"), "name", "root", "kind")).alias("item"))
    # data is JSON already, so it goes in as it is.
    concept = F.concat(F.lit('{"data":'), F.coalesce("data", F.lit("{}")), F.lit(","), F.substr(F.to_json(F.struct("key", "label")), F.lit(2)))
    concepts = own.filter("layer = 2 AND kind = 'concept'").select("project_id", F.lit(1).alias("part"), "key", concept.alias("item"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("id"))
    some = edges.filter("layer = 1").join(projects.select("project_id"), "project_id", "left_semi").withColumn("_place", place).filter(F.col("_place") <= EDGE_LIMIT)
    end = lambda name: nodes.select(F.col("id").alias(f"{name}_id"), F.col("key").alias(name))
    flat = some.select("project_id", "id", "relation", "source_id", "target_id").join(end("source"), "source_id").join(end("target"), "target_id")
    physical = flat.select("project_id", F.lit(2).alias("part"), F.col("id").alias("key"), F.to_json(F.struct("source", "relation", "target")).alias("item"))
    return head.unionByName(concepts).unionByName(physical)


def ask(command: str, pieces: Iterator[tuple[int, str]], timeout: float = TIMEOUT) -> str | None:
    """The answer to one request, an object in JSON; None for every failure. All ``pieces`` are taken."""
    part, head = next(pieces)
    root = json.loads(head).get("root") if part == 0 else None
    got: list[bytes] = []
    try:
        p = subprocess.Popen(shlex.split(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd=root if root and os.path.isdir(root) else None)
    except (OSError, ValueError):
        for _ in pieces:
            pass
        return None
    clock = threading.Timer(timeout, p.kill)
    clock.start()
    reader = threading.Thread(target=lambda: got.append(p.stdout.read()), daemon=True)
    reader.start()

    def text() -> Iterator[str]:
        yield f'{{"schema_version":1,"project":{head},"concepts":['
        last, first = 1, True
        for at, item in pieces:
            if at != last:
                yield '],"physical_edges":['
                last, first = at, True
            yield item if first else "," + item
            first = False
        yield ']}' if last == 2 else '],"physical_edges":[]}'

    try:
        open_ = True
        for x in text():
            if open_:
                try:
                    p.stdin.write(x.encode())
                except OSError:  # the program reads no further; its answer still counts
                    open_ = False
        try:
            p.stdin.close()
        except OSError:
            pass
        code = p.wait()
        reader.join(5)
    finally:
        clock.cancel()
        if p.poll() is None:
            p.kill()
    try:
        answer = b"".join(got).decode()
        return answer if code == 0 and isinstance(json.loads(answer), dict) else None
    except ValueError:
        return None


def answers(nodes: DataFrame, edges: DataFrame, projects: DataFrame, command: str, timeout: float = TIMEOUT) -> DataFrame:
    """(project_id, answer) of the projects whose provider answered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        for project, group in groupby(rows, key=lambda r: r[0]):
            answer = ask(command, ((part, item) for _, part, item in group), timeout)
            if answer is not None:
                yield pa.RecordBatch.from_arrays([pa.array([project], pa.string()), pa.array([answer], pa.string())], ["project_id", "answer"])

    pieces = requests(nodes, edges, projects).repartition("project_id").sortWithinPartitions("project_id", "part", "key")
    return pieces.select("project_id", "part", "item").mapInArrow(run, "project_id string, answer string")


def parsed(answer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, relations) for ``project.merge_provider`` of (project_id, answer); items without a key or an end are left out."""
    a = answer.select("project_id", F.from_json("answer", ANSWER_DDL).alias("a"))
    sure = lambda c: F.coalesce(c.try_cast("double"), F.lit(CONFIDENCE))
    named = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    c = a.select("project_id", F.posexplode("a.concepts").alias("place", "c")).withColumn("c", F.from_json("c", CONCEPT_DDL)).filter(named(F.col("c.key"))).withColumn("key", S.slug(F.col("c.key")))
    label = F.when(named(F.col("c.label")), F.col("c.label")).otherwise(S.humanize(F.col("key")))
    none = F.array().cast("array<string>")
    concepts = c.select("project_id", "place", "key", label.alias("label"), F.coalesce("c.files", none).alias("files"), sure(F.col("c.confidence")).alias("confidence"), F.coalesce("c.data", F.lit("{}")).alias("data"))
    r = a.select("project_id", F.posexplode("a.relations").alias("place", "r")).withColumn("r", F.from_json("r", RELATION_DDL)).filter(named(F.col("r.from")) & named(F.col("r.to")))
    relation = F.when(named(F.col("r.relation")), F.col("r.relation")).otherwise("related_to")
    relations = r.select("project_id", "place", S.slug(F.col("r.from")).alias("source"), relation.alias("relation"), S.slug(F.col("r.to")).alias("target"), sure(F.col("r.confidence")).alias("confidence"), F.coalesce("r.evidence", F.lit("[]")).alias("evidence"))
    return concepts, relations
