"""Log lines as a stream: one small machine a study, which keeps its state between batches and restarts.

The machine of a (job, study) holds its state and the place of the last line it has taken. Lines of a batch are taken in order; a
line at or before that place is a repeat (a log that was read again) and changes nothing, so a restart or a second reading
doesn't move a study. Each change is a row that is appended; the latest row of a study is its state. With `idle` a machine
that hears nothing for that long (by the clock) says so once, until it hears again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from verdure.operators import logs
from verdure.operators.tables import latest

CHANGES = "job string, study string, state string, pos long, n long, first_listed long"
#: The state store that keeps machines on disk; a session's own stays.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class StudyMachine(StatefulProcessor):
    """Guarded, ordered overwrites of a study's state. A batch's lines of one study are held at once; how many files a batch takes bounds them."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, pos long, n long, first_listed long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        state, pos, n, listed, timer = self.held.get() if self.held.exists() else (logs.STATES[0], -1, 0, None, None)
        began = state, pos
        for r in sorted(rows, key=lambda r: (r.pos, r.rule)):
            if r.pos > began[1]:
                state, pos, n = state if state in r.keeps else r.state, r.pos, n + 1
                listed = r.pos if r.listed and listed is None else listed
        if self.idle_ms:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.held.update((state, pos, n, listed, timer))
        if pos > began[1]:
            yield Row(job=key[0], study=key[1], state=state, pos=pos, n=n, first_listed=listed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, pos, n, listed, _ = self.held.get()
        self.held.update((state, pos, n, listed, None))
        yield Row(job=key[0], study=key[1], state=f"idle:{state}", pos=pos, n=n, first_listed=listed)

    def close(self) -> None:
        pass


def follow_logs(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """(job, pos, line) of log segments as they come, as operators.logs.read_logs numbers them; a segment is read whole."""
    raw = spark.readStream.schema(logs.LOG_SCHEMA).option("maxFilesPerTrigger", files_a_batch).text(path, wholetext=True)
    ended = F.regexp_replace("value", r"\r?\n$", "")
    return raw.select("job", "segment", F.posexplode(F.split(ended, r"\r?\n"))).select("job", (F.col("segment") * logs.SEGMENT + F.col("pos")).alias("pos"), F.col("col").alias("line"))


def changes(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """CHANGES of a stream of lines."""
    spark = lines.sparkSession
    if spark.conf.get(STORE[0], None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(*STORE)
    events = logs.study_events(lines)
    return events.groupBy("job", "study").transformWithState(StudyMachine(idle_ms), CHANGES, "Append", "ProcessingTime" if idle_ms else "None")


def append_changes(lines: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None) -> StreamingQuery:
    """Append all changes that are there to Parquet files under path; started again with the same checkpoint, it goes on where it was."""
    out = changes(lines, idle_ms).writeStream.format("parquet").outputMode("append")
    return out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """(job, study, state, n, last_pos, first_listed): the latest change of each study."""
    c = latest(spark.read.schema(CHANGES).parquet(path).withColumn("key", F.struct("job", "study")), "key", "pos", "n")
    return c.select("job", "study", "state", "n", F.col("pos").alias("last_pos"), "first_listed")
