"""Replay of the log as a stream: idempotent application, windows, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import working_folder


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A file stream over a Parquet log, a folder of files or one file."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return stream.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return stream.parquet(path)


def apply_once(batch: DataFrame, target: str, key: str, batch_id: int) -> None:
    """Append what the target does not hold yet. A repeated batch finds its own rows there, so effects are exactly once."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    folder = f"{target}/batch={batch_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.parquet(target).filter(F.col("batch") != batch_id).select(key)
        fresh = fresh.join(held, key, "left_anti")
    fresh.write.mode("overwrite").parquet(folder)


def replay_table(spark: SparkSession, path: str, columns: list[str], key: str, times: int = 1) -> DataFrame:
    """Replay a Parquet log ``times`` times into one target and read it: the ledger is the target itself."""
    base = working_folder(spark, "stream")
    for k in range(times):
        q = read_log(spark, path).select(*columns).writeStream.foreachBatch(lambda df, n, k=k: apply_once(df, f"{base}/applied", key, n + k * 1_000_000)).option("checkpointLocation", f"{base}/offsets-{k}").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/applied").select(*columns)


def windowed_counts(spark: SparkSession, path: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and type; windows are closed by a watermark, and the last ones by the end of the log."""
    base = working_folder(spark, "stream")
    stream = read_log(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = stream.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/counts/batch={n}")

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/counts")
    return rows.groupBy("hour", "event_type").agg(F.max_by("n", "batch").alias("n"))


def _fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keyed state of a session: its last started task and its active one."""
    started, active = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, kind in zip(rows["seq"], rows["event_type"], strict=True):
        if kind == "signup":
            started = active = int(seq)
        elif kind == "error" and started is not None:
            active = None
        out.append((int(seq), int(key[0]), active))
    state.update((started, active))
    yield pd.DataFrame(out, columns=["seq", "session", "active_task"]).astype({"active_task": "Int64"})


def streamed_active_task(spark: SparkSession, path: str) -> DataFrame:
    """active_task of every event by a stateful stream."""
    base = working_folder(spark, "stream")
    stream = read_log(spark, path).select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), "event_type")
    out = stream.groupBy("session").applyInPandasWithState(_fold, "seq long, session long, active_task long", "started long, active long", "append", "NoTimeout")
    out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/active").option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/active")
