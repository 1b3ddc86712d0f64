"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and the master is local, a folder of our own; on a cluster, an error, as executors there share no local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='verdure-')}"
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    return at.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, what: str = "cut", by: str | None = None) -> DataFrame:
    """Write df to the shared folder (a folder for each value of `by`) and read it again: later work doesn't recompute it when executors go."""
    spark = df.sparkSession
    path = fresh(spark, what)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def uncut(df: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    if path := getattr(df, "_cut_path", None):
        drop_path(df.sparkSession, path)
