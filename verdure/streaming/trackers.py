"""Status streams: latest state a key, guarded state fold, activity windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdure.operators import tables
from verdure.storage import fresh


def follow(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    """A growing folder as a stream."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path)


def latest_state(events: DataFrame, key: str, state: str, at: str) -> DataFrame:
    """Running (key, state, at): the latest; state is kept a key."""
    return events.groupBy(key).agg(F.max_by(state, at).alias(state), F.max(at).alias(at))


def guarded_state(events: DataFrame, key: str, state: str, priority: dict[str, int], at: str) -> DataFrame:
    """Running (key, state): no state overwrites one of higher priority; among equals the later one."""
    return tables.guarded_fold(events, key, state, priority, at)


def activity(events: DataFrame, at: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are left out."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, late).groupBy(w.alias("window"), *by).agg(F.count("*").alias("n"))


def upsert_sink(df: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in Parquet versions under path, one a micro-batch; a batch that is run again writes the same version."""

    def write(batch: DataFrame, n: int) -> None:
        old = f"{path}/v={n - 1}"
        spark = batch.sparkSession
        new = tables.latest(batch, key, order)
        if n:
            new = tables.latest(spark.read.parquet(old).unionByName(new), key, order)
        new.write.mode("overwrite").parquet(f"{path}/v={n}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return the table it made: of complete results the last, else all that was put out. Results and state go to the shared folder, not through the driver."""
    spark, versions = df.sparkSession, []
    path = fresh(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v={n}")
        versions.append(n)

    df.writeStream.foreachBatch(write).option("checkpointLocation", fresh(spark, f"{name}-state")).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if not versions:
        return spark.createDataFrame([], df.schema)
    some = [max(versions)] if mode == "complete" else sorted(set(versions))
    return spark.read.schema(df.schema).parquet(*[f"{path}/v={n}" for n in some])
