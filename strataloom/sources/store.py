"""Graph tables as Parquet, partitioned by project and layer; settings and the project registry.

A read that names a project or a layer prunes folders; a write replaces only the folders that its rows belong to.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from ..operators import graph

SCHEMA_VERSION = 1
PARTITIONS = ["project_id", "layer"]


class GraphStore:
    """Nodes and edges below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def check(self, writing: bool = False) -> None:
        """Refuse tables of another schema version, and ones that a write left half done."""
        if not writing and self._exists(f"{self.root}/writing"):
            raise ValueError("a write of the store did not end; write it again")
        if self._exists(f"{self.root}/meta"):
            found = self.spark.read.parquet(f"{self.root}/meta").agg(F.max("schema_version")).first()[0]
            if found != SCHEMA_VERSION:
                raise ValueError(f"the store has schema version {found}, this library {SCHEMA_VERSION}")

    def _mark(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/writing")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def write(self, nodes: DataFrame, edges: DataFrame, whole: list[str] = ()) -> None:
        """Replace the projects and layers that the rows belong to. Of the projects in ``whole`` the rows are all there is: layers without rows go.

        A mark stands while tables are written: reading after a write that died midway is an error, until it is written again.
        """
        self.check(writing=True)
        system, mark = self._mark()
        system.create(mark, True).close()
        for project in whole:
            for name, df in (("nodes", nodes), ("edges", edges)):
                kept = {r[0] for r in df.filter(F.col("project_id") == project).select("layer").distinct().collect()}  # three layers at most
                for layer in {1, 2, 3} - kept:
                    self._drop(name, project, layer)
        for name, df in (("nodes", nodes), ("edges", edges)):
            # One file for each folder and task: rows of a folder may come from many tasks, so a large layer is not one task's work.
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{self.root}/{name}")
        self.spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version")).write.mode("overwrite").parquet(f"{self.root}/meta")
        system.delete(mark, False)

    def read(self, name: str, project: str | None = None, layer: int | None = None) -> DataFrame:
        """nodes or edges, of one project or layer if named."""
        self.check()
        out = self.spark.read.parquet(f"{self.root}/{name}")
        if project is not None:
            out = out.filter(F.col("project_id") == project)
        return out if layer is None else out.filter(F.col("layer") == layer)

    def _drop(self, name: str, project: str, layer: int | str) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/project_id={project}/layer={layer}")
        system = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(bool(system.delete(status.getPath(), True)) for status in system.globStatus(p) or [])

    def drop(self, project: str | None = None, layer: int | None = None) -> int:
        """Delete whole folders of a project, a layer or both; their number."""
        return sum(self._drop(name, project or "*", "*" if layer is None else layer) for name in ("nodes", "edges"))


def content_digest(content: str = "content") -> Column:
    """Digest of a file's bytes; files of equal digests are equal."""
    return F.sha2(F.col(content), 256)


SETTINGS = {"max_file_bytes": 4 << 20, "ignore": [], "context_concepts": 5, "context_files": 12, "context_tasks": 5}


def settings(path: str | None = None, environment: dict[str, str] | None = None, prefix: str = "STRATALOOM_") -> dict:
    """Defaults, then a JSON file, then the environment; ignored names add up, unknown names are an error."""
    out = {k: list(v) if isinstance(v, list) else v for k, v in SETTINGS.items()}
    given: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        if not isinstance(given, dict):
            raise ValueError("settings are no object")
    for name, value in (os.environ if environment is None else environment).items():
        if name.startswith(prefix):
            key = name.removeprefix(prefix).lower()
            given[key] = [*given.get(key, []), *value.split(os.pathsep)] if isinstance(SETTINGS.get(key), list) else value
    for name, value in given.items():
        if name not in SETTINGS:
            raise ValueError(f"no such setting: {name}")
        if isinstance(SETTINGS[name], list):
            out[name] = list(dict.fromkeys([*out[name], *map(str, value)]))
        else:
            out[name] = int(value)
            if out[name] < 0:
                raise ValueError(f"{name} is negative")
    out["ignore"] = list(dict.fromkeys([*fixed.IGNORED_DIRECTORIES, *fixed.IGNORED_FILES, *out["ignore"]]))
    return out


def project_ids(projects: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """projects(name, root) with project_id: that of the registry for a root that ``known(project_id, root)`` has; else the slug of the name, and
    eight hex digits of the root's hash where a registered project or a new one of a smaller root has that slug already."""
    known = projects.sparkSession.createDataFrame([], "project_id string, root string") if known is None else known.select("project_id", "root")
    base = projects.join(known.select(F.col("project_id").alias("_known"), "root"), "root", "left").withColumn("_slug", S.slug(F.col("name")))
    first = base.filter("_known IS NULL").groupBy("_slug").agg(F.min("root").alias("_first"))
    taken = known.select(F.col("project_id").alias("_slug"), F.lit(True).alias("_taken")).distinct()
    out = base.join(first, "_slug", "left").join(taken, "_slug", "left")
    fresh = F.when(F.col("_taken").isNull() & (F.col("root") == F.col("_first")), F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.substring(F.sha2(F.col("root"), 256), 1, 8)))
    return out.select(*projects.columns, F.coalesce("_known", fresh).alias("project_id"))


def upsert_projects(known: DataFrame, snapshots: DataFrame) -> DataFrame:
    """known(project_id, name, root, kind, created_at, updated_at) after snapshots(project_id, name, root, kind, at, seq) of a log: the last one counts, the first time stays.

    A ValueError if any snapshot has a root that the registry or another snapshot has under another id.
    """
    said = snapshots.select("project_id", "root").distinct()
    last = snapshots.groupBy("project_id").agg(F.max_by(F.struct("name", "root", "kind", "at"), "seq").alias("s"), F.min_by("at", "seq").alias("first"))
    new = last.select("project_id", F.coalesce("s.name", S.basename(F.col("s.root"))).alias("name"), "s.root", F.coalesce("s.kind", F.lit("generic")).alias("kind"), F.col("first").alias("created_at"), F.col("s.at").alias("updated_at"))
    wrong = conflicts(known.select("project_id", "root").unionByName(said), said).first()
    if wrong is not None:
        raise ValueError(f"{wrong['root']} is registered as {wrong['known_id']}, not as {wrong['project_id']}")
    return graph.upsert(known, new.select(known.columns), ["project_id"])


def conflicts(known: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshots of projects(project_id, root) whose root the registry has under another id."""
    return new.select("project_id", "root").join(known.select(F.col("project_id").alias("known_id"), "root"), "root").filter("project_id <> known_id")
