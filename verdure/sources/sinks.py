"""Writers: matrices, sample maps, metadata, labels, statuses and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_matrix(m: DataFrame, path: str, by: str | None = None) -> None:
    """The long matrix as Parquet, by study if named."""
    w = m.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def write_sample_map(m: DataFrame, path: str) -> None:
    m.select(F.col("sample_id").alias("SampleID"), F.col("study_id").alias("StudyID")).distinct().write.mode("overwrite").csv(path, header=True)


def write_demultiplexed(merged: DataFrame, owner: DataFrame, path: str) -> None:
    """A folder a study, by the (sample_id, study_id) map; samples without a study are not written."""
    merged.join(owner.select("sample_id", "study_id"), "sample_id").write.mode("overwrite").partitionBy("study_id").parquet(path)


def without_keys(m: Column, words: tuple[str, ...]) -> Column:
    """A map without the keys that hold one of the words."""
    bad = lambda k: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: k.contains(w))
    return F.map_filter(m, lambda k, v: ~bad(k))


def write_metadata_json(df: DataFrame, path: str, words: tuple[str, ...] = ("contact", "supplementary")) -> None:
    df.withColumn("sample_metadata", without_keys(F.col("sample_metadata"), words)).write.mode("overwrite").json(path)


def characteristics(df: DataFrame, col: str = "characteristics") -> DataFrame:
    """(sample_id, key, value) of 'key: value' strings: keys in lower case with _, characteristic_n where there is no colon."""
    x = df.select("sample_id", F.posexplode(col).alias("n", "s"))
    has = F.col("s").contains(":")
    key = F.when(has, F.lower(F.replace(F.trim(F.split_part("s", F.lit(":"), F.lit(1))), F.lit(" "), F.lit("_")))).otherwise(F.concat(F.lit("characteristic_"), F.col("n").cast("string")))
    return x.select("sample_id", key.alias("key"), F.trim(F.when(has, F.regexp_replace("s", r"^[^:]*:", "")).otherwise(F.col("s"))).alias("value"))


def write_labels_csv(df: DataFrame, path: str, axes: list[str]) -> None:
    """Arrays as sorted values joined by _, nulls as 'unspecified'."""
    kinds = dict(df.dtypes)
    cols = [F.coalesce(F.nullif(F.array_join(F.array_sort(F.transform(a, lambda x: x.cast("string"))), "_") if kinds[a].startswith("array") else F.col(a).cast("string"), F.lit("")), F.lit("unspecified")).alias(a) for a in axes]
    df.select("sample_id", "study_id", *cols).write.mode("overwrite").csv(path, header=True)


def append_status(df: DataFrame, path: str) -> None:
    """Status changes are appended; the current state is the latest row of each study."""
    df.select("study_id", "code", "at").write.mode("append").parquet(path)


def samplesheet_without(sheet: DataFrame, bad: DataFrame) -> tuple[DataFrame, int]:
    """(the sheet without the bad samples, how many went)."""
    kept = sheet.join(bad.select("sample"), "sample", "left_anti")
    return kept, sheet.count() - kept.count()


def write_id_list(df: DataFrame, path: str, col: str = "id", order: str = "pos") -> None:
    """One id a line, in order."""
    df.orderBy(order).select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)
