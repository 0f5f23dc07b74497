"""The task layer from a stream of log lines: keyed state for each session, partials of the folds for each trigger.

A line's place in the log (seq) is its event time, one second a place: files may bring lines in any order, as long as none comes
more than ``late`` places behind a later one. Repeated event ids are dropped within that distance by the engine's own state.
Closes meet the creation of their task in a stream-stream join, which gives them their session and drops those of unknown tasks
(the ids of tasks are created once). Then ``Sessions`` keeps a session's lines until the watermark has passed them, folds them
in the order of the log and emits them with the session's running task before and after each. Its keys are buckets of sessions,
so calls to keyed state grow with buckets, and once a release with sessions, but not with lines.

Each trigger adds its lines and their partials to a ``layer3.TaskState`` as a piece of its own and reads nothing back, so its cost
does not grow with what was streamed before; a trigger that is repeated writes the same piece again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import layer3

STORE = {  # keyed state needs RocksDB; a commit writes what changed instead of a snapshot; the stores of an executor share one bound of memory
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
PARTITIONS = "spark.sql.shuffle.partitions"
TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}  # lines travel as JSON without losing digits
FLUSH = "flush"  # the type of a line that only moves the watermark
STATE = T.StructType([T.StructField("started", T.StringType()), T.StructField("active", T.StringType())])
SESSION = T.StructType([T.StructField("named", T.BooleanType()), T.StructField("session", T.StringType())])  # a line may name no session
PENDING = T.StructType([T.StructField("lines", T.BinaryType())])
DUE = T.StructType([T.StructField("seq", T.LongType())])
HELD = pa.schema([("session", pa.string()), ("seq", pa.int64()), ("event_type", pa.string()), ("task", pa.string()), ("line", pa.string())])
BUCKETS = 512  # keys of state; a session lies in one
FRAME_ROWS = 10_000  # of a frame that is given out
OUTPUT = T.StructType([T.StructField("line", T.StringType()), T.StructField("session", T.StringType()), T.StructField("started", T.StringType()), T.StructField("before", T.StringType()), T.StructField("active_task", T.StringType())])


def folded(rows: list[tuple], started: str | None, active: str | None) -> tuple[list[tuple], str | None, str | None]:
    """(line, started, before, active) of a session's next lines (seq, event_type, task, line) in order, and its state after them."""
    out = []
    for _, kind, task, line in rows:
        before = active
        if kind == "task_created":
            started = active = task
        elif kind == "session_end" or kind == "task_closed" and started is not None and task == started:
            active = None
        out.append((line, started, before, active))
    return out, started, active


def packed(lines: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(lines, HELD, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(chunk: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(chunk).read_all()
    return list(zip(*(table[c].to_pylist() for c in HELD.names), strict=True))


class Sessions(StatefulProcessor):
    """The sessions of a bucket. Map state: the task that each started last and its running one. List state: packed lines that the watermark has not passed. Value state: when the timer is due.

    A call to keyed state costs as much for a line as for thousands, so lines are kept by trigger and bucket, not one by one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", SESSION, STATE)
        self.pending = handle.getListState("pending", PENDING)
        self.due = handle.getValueState("due", DUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            if len(frame):
                self.pending.appendValue((packed(frame),))
                least = int(frame["seq"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            known = self.due.get()
            if known is None or first < known[0]:
                if known is not None:
                    self.handle.deleteTimer((known[0] + 1) * 1000)
                self.wake(first)
        return iter([])

    def wake(self, seq: int) -> None:
        self.handle.registerTimer((seq + 1) * 1000)
        self.due.update((seq,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        due, rest = defaultdict(list), []
        for (chunk,) in self.pending.get():
            for session, *line in unpacked(chunk):
                (due[session] if line[0] < passed else rest).append((session, *line))
        if rest:
            self.pending.put([(packed(pd.DataFrame(rest, columns=HELD.names)),)])
            self.wake(min(r[1] for r in rest))
        else:
            self.pending.clear()
            self.due.clear()
        released, stored = [], self.state.exists()
        for session, lines in due.items():
            at = (session is not None, session or "")
            known = self.state.getValue(at) if stored else None
            before = tuple(known) if known is not None else (None, None)
            lines.sort(key=lambda r: (r[1], r[2], r[3] or "", r[4]))
            out, *after = folded([r[1:] for r in lines if r[2] != FLUSH], *before)
            if tuple(after) != before:
                self.state.updateValue(at, tuple(after))
            released += [(line, session, *more) for line, *more in out]
        for k in range(0, len(released), FRAME_ROWS):
            yield pd.DataFrame(released[k : k + FRAME_ROWS], columns=OUTPUT.names)

    def close(self) -> None:
        pass


def active_stream(lines: DataFrame, late: int) -> DataFrame:
    """A stream of typed ``lines`` with started, before and active_task, as ``layer3.active_lines`` gives them for a whole log."""
    at = F.timestamp_seconds(F.col("seq") + 1)  # the watermark begins at 0 and would call a first line late
    clean = lines.filter("error IS NULL").withColumn("at", at).withWatermark("at", f"{late} seconds").dropDuplicatesWithinWatermark(["event_id"])
    births = clean.filter("event_type = 'task_created'").select(F.col("project_id").alias("_project"), F.col("task").alias("_task"), F.col("seq").alias("_born"), F.col("session").alias("_owner"))
    known = (F.col("project_id") == F.col("_project")) & (F.col("task") == F.col("_task")) & (F.col("_born") < F.col("seq"))
    closes = clean.filter("event_type = 'task_closed'").join(births, known).withColumn("session", F.coalesce("session", "_owner")).drop("_project", "_task", "_born", "_owner")
    every = clean.filter("event_type <> 'task_closed'").unionByName(closes)
    columns = [c for c in lines.columns if c != "session"]
    bucket = F.pmod(F.xxhash64("session"), F.lit(BUCKETS)).alias("bucket")
    every = every.select(bucket, "session", "seq", "event_type", "task", F.to_json(F.struct(*columns), TIMES).alias("line"), "at")
    out = every.groupBy("bucket").transformWithStateInPandas(Sessions(), OUTPUT, "Append", "EventTime")
    shape = T.StructType([lines.schema[c] for c in columns])
    return out.select(F.from_json("line", shape, TIMES).alias("l"), "session", "started", "before", "active_task").select("l.*", "session", "started", "before", "active_task")


def flush_line(lines: DataFrame, seq: int) -> DataFrame:
    """One line behind all others that lets the watermark pass them: the last file of a log that has an end."""
    values = {"seq": F.lit(seq).cast("long"), "event_id": F.lit(f"flush-{seq}"), "event_type": F.lit(FLUSH), "session": F.lit("")}
    return lines.sparkSession.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in lines.schema])


def stream_into(lines: DataFrame, state: layer3.TaskState, offsets: str, late: int, partitions: int | None = None):
    """Start a query that folds a stream of typed ``lines`` into ``state``, a piece for each trigger that releases lines; it ends when the source holds no more.

    Each trigger commits a store for every stateful step and partition, however few its lines are, so ``partitions`` is the number of cores unless given.
    """
    spark: SparkSession = lines.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        state.add(batch, number, empty=False)

    # The query keeps the settings that it starts with; the session gets its own back.
    own = {k: spark.conf.get(k, None) for k in STORE} | {PARTITIONS: spark.conf.get(PARTITIONS)}
    for k, v in (STORE | {PARTITIONS: str(partitions or spark.sparkContext.defaultParallelism)}).items():
        spark.conf.set(k, v)
    try:
        return active_stream(lines, late).writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
