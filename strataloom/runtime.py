"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's checkout; a cluster that ships it otherwise is unaffected."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if HOME not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (HOME, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_FOLDERS: list[str] = []


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in the one that ``spark.checkpoint.dir`` names; a temporary one only on a local master that names none.

    ``clean`` deletes it, and the driver's end does so for folders in mounted stores.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "strataloom")
    _FOLDERS.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clean(spark: SparkSession) -> None:
    """Delete all working folders of this process; call it when results that read them have been read."""
    while _FOLDERS:
        p = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean_files() -> None:
    for path in _FOLDERS:
        if path.startswith(("/", "file:/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in a working folder and read again: cuts long plans and survives lost executors."""
    path = working_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
