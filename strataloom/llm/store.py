"""Tables shared by driver and executors: lineage is cut by writing Parquet below ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_WRITTEN: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not dropped; call it when their results have been read."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


@atexit.register
def _clean_files() -> None:
    """At the driver's end, when no session is left, tables in mounted folders go; other stores need ``clean``."""
    for path in _WRITTEN:
        if path.startswith(("/", "file:/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "strataloom")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strataloom_path = path
    return out


def derived(df: DataFrame, of: DataFrame) -> DataFrame:
    """``df``, which reads the table ``of`` and nothing else that is stored, so that ``drop`` takes it."""
    df._strataloom_path = getattr(of, "_strataloom_path", None)
    return df


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_strataloom_path", None)
        if path in _WRITTEN:
            _WRITTEN.remove(path)
            _delete(df.sparkSession, path)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches of long texts small; a smaller setting of the user's stays."""
    if int(spark.conf.get(ARROW_ROWS, "10000")) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def buckets(spark: SparkSession) -> int:
    """Hash buckets for blob shuffles: one per shuffle partition, which is how users size a job to its data."""
    return max(1, min(65536, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))


def give_back() -> None:
    """Return what a Python worker has freed to the system: workers live on into later stages, and the allocator keeps freed blocks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
