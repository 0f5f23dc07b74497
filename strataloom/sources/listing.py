"""File listings and change sets."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import scalars as S
from . import rules

LISTING = "path string, mtime_ns long, size long"


def git_files(root: str, timeout: float = 20.0) -> list[str] | None:
    """Tracked and untracked files that git does not ignore; null if the folder has no git."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, timeout=timeout, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    names = (os.fsdecode(x) for x in done.stdout.split(b"\0") if x)
    return sorted(n for n in names if os.path.isfile(os.path.join(root, n)))


def project_root(path: str, timeout: float = 20.0) -> str:
    """The top of the git work tree that holds a file or folder, else the folder itself; a FileNotFoundError if there is none."""
    full = os.path.realpath(os.path.expanduser(path))
    folder = os.path.dirname(full) if os.path.isfile(full) else full
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    try:
        top = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError):
        return folder
    return top.stdout.strip() if top.returncode == 0 and top.stdout.strip() else folder


def project_files(spark: SparkSession, root: str, ignored_directories: Sequence[str] = tuple(fixed.IGNORED_DIRECTORIES), ignored_files: Sequence[str] = tuple(fixed.IGNORED_FILES)) -> DataFrame:
    """path, mtime_ns, size of a project on the driver's disk. The walk skips ignored folders; git decides about files where it can."""
    known = git_files(root)
    allowed = None if known is None else set(known)
    rows = []
    for folder, names, found in os.walk(root):
        names[:] = sorted(n for n in names if n not in ignored_directories)
        for name in sorted(found):
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root).replace(os.sep, "/")
            if name not in ignored_files and (allowed is None or path in allowed):
                s = os.stat(full)
                rows.append((path, s.st_mtime_ns, s.st_size))
    return spark.createDataFrame(rows, LISTING)


def stored_files(spark: SparkSession, root: str, ignored_directories: Sequence[str] = tuple(fixed.IGNORED_DIRECTORIES)) -> DataFrame:
    """path below the root, mtime_ns, size, content of files in any store that Spark reads; content is only read if a plan uses it.

    Names are ignored below the root only: the root itself may lie in a folder of such a name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    path = F.substr("path", F.lit(len(whole.rstrip("/")) + 2), F.length("path"))
    parts = F.split(path, "/")
    kept = ~F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x.isin(list(ignored_directories))) & ~F.element_at(parts, -1).isin(fixed.IGNORED_FILES)
    return raw.filter(kept).select(path.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), "content")


def text_content(c: Column, size: Column, limit: int = 4 * 1024 * 1024) -> Column:
    """Text of a small file without NUL bytes in its head that is valid UTF-8, else null."""
    head = F.substring(c, 1, 4096)
    text = F.try_validate_utf8(c.cast("string"))
    return F.when((size <= limit) & ~F.contains(head, F.lit(b"\x00")), F.regexp_replace(text, "^\\x{FEFF}", ""))


def change_set(now: DataFrame, before: DataFrame, keys: Sequence[str] = ("path",), compare: Sequence[str] = ("mtime_ns", "size", "signature")) -> DataFrame:
    """Keys with change new, deleted or changed; unchanged ones are left out. One full-outer join."""
    a = now.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(True).alias("_a"))
    b = before.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in compare], F.lit(True).alias("_b"))
    differs = F.lit(False)
    for c in compare:
        differs = differs | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(differs, "changed")
    return a.join(b, list(keys), "full").select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def dependents(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Sources of edges(source, target) into deleted paths, which are read again."""
    return edges.join(deleted.select(F.col("path").alias("target")), "target", "left_semi").select(F.col("source").alias("path")).distinct()


def project_kind(files: DataFrame, sample: int = 500) -> DataFrame:
    """One row: software by a marker file, else video or writing by the first files in path order, else generic."""
    marker = files.agg(F.count_if(F.col("path").isin(rules.SOFTWARE_MARKERS)).alias("m"))
    name = S.suffix(F.col("path"))
    first = files.orderBy("path").limit(sample).agg(F.count_if(name.isin(rules.VIDEO_EXTENSIONS)).alias("v"), F.count_if(name.isin(rules.WRITING_EXTENSIONS)).alias("d"))
    return marker.crossJoin(first).select(F.when(F.col("m") > 0, "software").when(F.col("v") >= 3, "video").when(F.col("d") >= 5, "writing").otherwise("generic").alias("kind"))
