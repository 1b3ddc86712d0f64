"""Sinks that can be killed and run again: staged results with a done marker, facts and run logs that are appended, lists that are archived.

A result is written beside its place, moved there in one rename, and then marked done with its number of rows. A run that was
killed leaves a stage or an unmarked result, which the next run replaces; a run that finds the marker leaves everything as it is.
One writer at a time is assumed for a path.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.operators.tables import latest

DONE = "_DONE"
FACTS = "study_id string, kind string, value string, at timestamp"


def _fs(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a path, whatever store it is in."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, new)
    fs.mkdirs(at.getParent())
    if not fs.rename(_fs(spark, old)[1], at):
        raise OSError(f"could not move {old} to {new}")


def _say(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def is_done(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/{DONE}")


def write_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], order: tuple = (), fmt: str = "parquet", least: int = 0) -> bool:
    """Write what make() gives to path, in order, unless it is done there already; True if it was written.

    make() isn't called when it is done. A result of fewer than `least` rows stays, but isn't marked done, so the next run tries again.
    """
    if is_done(spark, path):
        return False
    stage = f"{path.rstrip('/')}.stage"
    for old in (stage, path):
        remove(spark, old)
    df = make()
    w = (df.orderBy(*order) if order else df).write.mode("overwrite")
    (w.csv(stage, header=True) if fmt == "csv" else w.format(fmt).save(stage))
    n = (spark.read.csv(stage, header=True) if fmt == "csv" else spark.read.format(fmt).load(stage)).count()
    move(spark, stage, path)
    if n >= least:
        _say(spark, f"{path}/{DONE}", json.dumps({"rows": n}))
    return True


def append_facts(df: DataFrame, path: str) -> None:
    """Append (study_id, kind, value, at): a status code, an ecotype, the JSON of a study's metadata, or whatever is known of a study."""
    kinds = T._parse_datatype_string(FACTS)
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).write.mode("append").parquet(path)


def current_facts(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> DataFrame:
    """(study_id, a column a kind): the latest value of each (of equal times the larger); NULL if nothing was said of it."""
    f = spark.read.schema(FACTS).parquet(path).where(F.col("kind").isin(*kinds))
    return f.groupBy("study_id").agg(*[F.max_by("value", F.when(F.col("kind") == k, F.struct("at", "value"))).alias(k) for k in kinds])


def study_report(facts: DataFrame, meta: str = "meta") -> DataFrame:
    """(study_id, platform, num_samples, has_raw) of the metadata that is JSON; Unknown, 0 and false for what it doesn't tell."""
    v = facts.select("study_id", F.try_parse_json(meta).alias("v")).where("v IS NOT NULL")
    get = lambda k, kind, rest: F.coalesce(F.try_variant_get("v", f"$.{k}", kind), F.lit(rest)).alias(k)
    return v.select("study_id", get("platform", "string", "Unknown"), get("num_samples", "int", 0), get("has_raw", "boolean", False))


def replace_list(df: DataFrame, path: str, stamp: str) -> bool:
    """Make df (study_id, sample) the current list of missing samples under path, and move the one before to archive/stamp=...; False if this stamp is the current one.

    A run that was killed between the two is finished by the next with the same stamp: what is archived stays archived.
    """
    spark = df.sparkSession
    now, done = f"{path}/current", f"{path}/current/stamp={stamp}"
    if exists(spark, done):
        return False
    stage = f"{path}/stage"
    remove(spark, stage)
    df.select("study_id", "sample").write.mode("overwrite").parquet(f"{stage}/stamp={stamp}")
    if exists(spark, now):
        move(spark, now, f"{path}/archive/until={stamp}")
    move(spark, stage, now)
    return True


def missing_now(spark: SparkSession, path: str) -> DataFrame:
    """(study_id, samples, n) of the current list."""
    d = spark.read.schema("study_id string, sample string").parquet(f"{path}/current/*")
    return d.groupBy("study_id").agg(F.array_sort(F.collect_set("sample")).alias("samples"), F.count_distinct("sample").alias("n"))


def write_missing_lists(df: DataFrame, path: str, order: str) -> None:
    """df (study_id, sample) as lists in order, in as many text files as there are partitions and not one a study: lines <study>_missing_samples.txt:<sample>. A study's list is in one file."""
    d = df.select(F.concat("study_id", F.lit("_missing_samples.txt")).alias("file"), "sample", order)
    d.repartition("file").sortWithinPartitions("file", order).select(F.concat_ws(":", "file", "sample").alias("value")).write.text(path)


def missing_lists(spark: SparkSession, path: str) -> DataFrame:
    """(study_id, samples, n) of files <study>_missing_samples.txt, a sample a line in order, or of files of write_missing_lists, which hold many; blank lines go, and files without a sample have no row."""
    name = r"([^/=:]+)_missing_samples\.txt"
    own = F.regexp_extract("value", f"^{name}:", 1)
    raw = spark.read.text(path).select(F.when(own != "", own).otherwise(F.regexp_extract("_metadata.file_path", name, 1)).alias("study_id"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("i"), F.trim(F.regexp_replace("value", f"^{name}:", "")).alias("sample"))
    lists = raw.where("study_id <> '' AND sample <> ''").groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("at", "i", "sample"))).alias("s"))
    return lists.select("study_id", F.transform("s", lambda x: x["sample"]).alias("samples"), F.size("s").cast("long").alias("n"))


def log_run(spark: SparkSession, path: str, run_id: str, at: str, notes: str = "", **settings) -> bool:
    """Append a run's start, settings and notes to the log under path, once for each run_id; False if it is there."""
    schema = "run_id string, at timestamp, notes string, settings map<string,string>"
    if exists(spark, path) and not spark.read.schema(schema).parquet(path).where(F.col("run_id") == run_id).isEmpty():
        return False
    row = spark.createDataFrame([(run_id, at, notes or "(none provided)", {k: str(v) for k, v in settings.items()})], "run_id string, at string, notes string, settings map<string,string>")
    row.withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(path)
    return True


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    """(study_id, value, at): each study's last status among the facts."""
    return latest(spark.read.schema(FACTS).parquet(path).where("kind = 'status'"), "study_id", "at", "value").select("study_id", "value", "at")
