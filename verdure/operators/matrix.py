"""Long expression matrices (gene_id, sample_id, value): filters, duplicates, fusion, normalisation.

Absent cells are missing cells; NULL, NaN and 0 count as missing too where a filter says so.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(value: str = "value") -> Column:
    return F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != 0)


def with_scalar(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row frame (an ungrouped aggregate)."""
    return df.crossJoin(F.broadcast(one))


def missing_share(m: DataFrame, by: str = "gene_id", over: str = "sample_id") -> DataFrame:
    """(by, missing_pct): share of `over` in which `by` has no present value."""
    n = m.agg(F.countDistinct(over).alias("n_over"))
    seen = m.groupBy(by).agg(F.countDistinct(F.when(present(), F.col(over))).alias("n_present"))
    return with_scalar(seen, n).select(by, (100 * (1 - F.col("n_present") / F.col("n_over"))).alias("missing_pct"))


def filter_missing(m: DataFrame, by: str = "gene_id", over: str = "sample_id", most_pct: float = 100.0) -> DataFrame:
    """Rows of those `by` whose missing share is at most most_pct."""
    return m.join(missing_share(m, by, over).where(F.col("missing_pct") <= most_pct).select(by), by, "left_semi")


def filter_matrix(m: DataFrame, gene_pct: float = 100.0, sample_pct: float = 60.0) -> DataFrame:
    """Genes first, then samples over the genes that stay."""
    return filter_missing(filter_missing(m, "gene_id", "sample_id", gene_pct), "sample_id", "gene_id", sample_pct)


def guard_range(m: DataFrame, most: float = 20.0) -> DataFrame:
    """m, failing at run time if a value is above `most` (raw intensities where logs are due)."""
    bad = F.raise_error(F.concat(F.lit("value above range: "), F.col("value").cast("string")))
    return m.withColumn("value", F.when(F.col("value") > most, bad.cast("double")).otherwise(F.col("value")))


def log2_1p(m: DataFrame) -> DataFrame:
    return m.withColumn("value", F.log2(F.col("value") + 1))


def normalise_counts(m: DataFrame, gene_pct: float = 100.0, sample_pct: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """(filtered, log2(x + 1) of it)."""
    kept = filter_matrix(m, gene_pct, sample_pct)
    return kept, log2_1p(kept)


def combine_duplicates(m: DataFrame, how: str | Callable[[Column], Column] = "avg", keys: tuple[str, ...] = ("gene_id", "sample_id")) -> DataFrame:
    """One value a cell; how: an aggregate's name (avg, sum, max, ...) or a function from a column to an aggregate."""
    f = getattr(F, how) if isinstance(how, str) else how
    return m.groupBy(*keys).agg(f(F.col("value")).alias("value"))


def without_isoform(gene: str = "gene_id") -> Column:
    return F.split_part(F.col(gene).cast("string"), F.lit("."), F.lit(1))


def noise_filter(m: DataFrame, above: float = 10.0, samples: int = 3) -> DataFrame:
    """Genes with values above `above` in at least `samples` samples."""
    good = m.groupBy("gene_id").agg(F.countDistinct(F.when(F.col("value") > above, F.col("sample_id"))).alias("n")).where(F.col("n") >= samples)
    return m.join(good.select("gene_id"), "gene_id", "left_semi")


def drop_small_batches(m: DataFrame, batch: str = "study_id", least: int = 2) -> DataFrame:
    """Rows of batches with at least `least` samples."""
    big = m.groupBy(batch).agg(F.countDistinct("sample_id").alias("n")).where(F.col("n") >= least)
    return m.join(big.select(batch), batch, "left_semi")


def fuse(parts: dict[str, DataFrame]) -> DataFrame:
    """All matrices in one long frame with a study_id; duplicate cells become their mean."""
    tagged = [m.select("gene_id", "sample_id", "value", F.lit(k).alias("study_id")) for k, m in parts.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("study_id", "gene_id", "sample_id").agg(F.avg("value").alias("value"))


def fuse_wide(parts: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of gene-level columns: gene_id and one column a part (a mean where a gene repeats)."""
    cols = [m.groupBy("gene_id").agg(F.avg("value").alias(k)) for k, m in parts.items()]
    return reduce(lambda a, b: a.join(b, "gene_id", "full"), cols)


def common_genes(m: DataFrame, part: str) -> DataFrame:
    """Genes that occur in every value of `part`."""
    n = m.agg(F.countDistinct(part).alias("n_parts"))
    each = m.groupBy("gene_id").agg(F.countDistinct(part).alias("n"))
    return with_scalar(each, n).where("n = n_parts").select("gene_id")


def to_vectors(m: DataFrame, by: str = "sample_id", order: str = "gene_id") -> DataFrame:
    """(by, values): values in the order of `order`."""
    pairs = F.array_sort(F.collect_list(F.struct(order, "value")))
    return m.groupBy(by).agg(F.transform(pairs, lambda p: p["value"]).alias("values"))


def histogram(m: DataFrame, bins: int = 300, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bin, n): bins of width max / bins from 0; missing values count as 0."""
    v = m.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    top = v.agg(F.max("value").alias("top"))
    at = F.least(F.floor(F.col("value") / (F.col("top") / bins)), F.lit(bins - 1)).cast("int")
    return with_scalar(v, top).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))


def study_max_log(frame: DataFrame, limit: float = 300.0) -> DataFrame:
    """(study_id, sample_id, data array): log2(x + 1) of all of a study whose largest value is above `limit`."""
    top = F.max(F.array_max("data")).over(Window.partitionBy("study_id"))
    return frame.withColumn("data", F.when(top > limit, F.transform("data", lambda x: F.log2(x + 1))).otherwise(F.col("data")))
