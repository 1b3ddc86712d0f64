"""Ranks, cumulative shares, first and best rows, top-k and samples: the window-like operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.storage import cut


def percent_rank_average(df: DataFrame, value: str = "value", by: tuple[str, ...] = ("sample_id",), out: str = "pct") -> DataFrame:
    """Rank over count within `by`, ties at their average; NULL and NaN get NULL."""
    clean = F.when(~F.isnan(value), F.col(value))
    w = Window.partitionBy(*by).orderBy(clean.asc_nulls_last())
    ties = F.count(clean).over(Window.partitionBy(*by, clean))
    pct = (F.rank().over(w) + (ties - 1) / 2) / F.count(clean).over(Window.partitionBy(*by))
    return df.withColumn(out, F.when(clean.isNotNull(), pct))


def ranges(df: DataFrame, value: str, out: str = "_b", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with the number of the range of value a row falls in, one row a range: out, _n of all rows and _upto of the rows up to its end).

    Ranges ascend and hold about as many rows each; equal values share one; NULL and NaN get NULL and aren't counted. As many ranges as shuffle partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value).cast("double")
    clean = F.when(~F.isnan(v), v)
    bounds = sorted(set(df.agg(F.percentile_approx(clean, [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []))
    low = F.array(*[F.lit(float(x)) for x in bounds]) if bounds else F.array().cast("array<double>")
    at = F.when(clean.isNotNull(), F.size(F.filter(low, lambda x: x < clean)))
    d = df.withColumn(out, at)
    n = d.where(F.col(out).isNotNull()).groupBy(out).agg(F.count("*").alias("_k"))
    w = Window.orderBy(out)
    ends = n.select(out, F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"), F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_upto"))
    return d, ends


#: Rows of a group up to which it is one range.
GROUP_ROWS = 1 << 17


def group_ranges(df: DataFrame, value: str, by: tuple[str, ...], rows: int | None = None) -> DataFrame:
    """df with _b, _before, _n: the range of value a row falls in within its group, the group's rows in ranges below and in all.

    Only groups of more than `rows` rows are cut, into as many ranges as shuffle partitions, so a hot group is no one's task and the others
    cost nothing; equal values share a range. NULL is in a range of its own before, NaN after all others. Rows of a NULL group stay one range.
    """
    rows, parts = rows or GROUP_ROWS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(value).cast("double")
    large = df.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") > rows).select(*by)
    marks = [k / parts for k in range(1, parts)] or [0.5]
    bounds = df.join(large, list(by), "left_semi").groupBy(*by).agg(F.percentile_approx(F.when(~F.isnan(v), v), marks, 20 * parts).alias("_q"))
    d = df.join(cut(bounds, "bounds"), list(by), "left")  # written: percentile_approx worked out twice can give two sets of bounds
    at = F.when(F.col("_q").isNull(), 0).when(v.isNull(), -1).when(F.isnan(v), 1 << 30).otherwise(F.size(F.filter("_q", lambda x: x < v)))
    d = d.withColumn("_b", at)
    w = Window.partitionBy(*by).orderBy("_b")
    k = d.where("_q IS NOT NULL").groupBy(*by, "_b").agg(F.count("*").alias("_k"))
    k = k.select(*by, "_b", F.coalesce(F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    d = d.drop("_q").join(k, [*by, "_b"], "left")
    return d.withColumn("_n", F.coalesce("_n", F.count("*").over(Window.partitionBy(*by, "_b")))).withColumn("_before", F.coalesce("_before", F.lit(0)))


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Rank over the whole table, ties at their average, without gathering it in one task; NULL and NaN get NULL."""
    d, ends = ranges(df, value, "_b")
    w = Window.partitionBy("_b").orderBy(F.desc(value))
    ties = F.count("*").over(Window.partitionBy("_b", value))
    d = d.join(F.broadcast(ends.select("_b", "_upto")), "_b", "left")
    return d.withColumn(out, F.when(F.col("_b").isNotNull(), F.col("_upto") - F.rank().over(w) + 1 - (ties - 1) / 2)).drop("_b", "_upto")


def rank_bins(df: DataFrame, n_bins: int = 100, value: str = "value", by: tuple[str, ...] = ("sample_id",), out: str = "bin") -> DataFrame:
    """ceil(average percent rank x n_bins): 1 to n_bins."""
    return percent_rank_average(df, value, by, "_pct").withColumn(out, F.ceil(F.col("_pct") * n_bins).cast("long")).drop("_pct")


def weighted_ranks(df: DataFrame, n_bins: int = 100, value: str = "value", sample: str = "sample_id") -> DataFrame:
    """Rank-In steps 1 and 2: adds bin r, the sample's quadratic fit value = a r^2 + b r + c, weight 2 a r + b and weighted = r x weight; a sample without a fit gets a = 0, b = 1."""
    r = rank_bins(df, n_bins, value, (sample,), "r")
    x, y = F.col("r").cast("double"), F.col(value)
    s = r.groupBy(sample).agg(F.count(y).cast("double").alias("n"), *(F.sum(x**k).alias(f"s{k}") for k in (1, 2, 3, 4)), *(F.sum(x**k * y).alias(f"t{k}") for k in (0, 1, 2)))
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / det
    b = (s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / det
    ok = F.abs(det) > 1e-9
    fit = s.select(sample, F.when(ok, a).otherwise(0.0).alias("a"), F.when(ok, b).otherwise(1.0).alias("b"))
    return r.join(fit, sample).withColumn("weight", 2 * F.col("a") * F.col("r") + F.col("b")).withColumn("weighted", F.col("r") * F.col("weight"))


def center(df: DataFrame, by: tuple[str, ...], value: str = "value", out: str = "centered") -> DataFrame:
    """value less its mean within `by`."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def first_per(df: DataFrame, keys: tuple[str, ...], *order: Column | str) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def take_per(df: DataFrame, keys: tuple[str, ...], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key in this order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def rank_percentile(df: DataFrame, by: tuple[str, ...], *order: Column | str, rows: int | None = None) -> DataFrame:
    """Adds term_rank (1 is first), n_terms and percentile (rank - 1) / (n - 1) x 100, 0 for a single row. Where the first of order is the name of a number, large groups are ranked by ranges of it."""
    if isinstance(order[0], str) and dict(df.dtypes)[order[0]].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
        d = group_ranges(df, order[0], by, rows)
        place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
        out = d.withColumn("term_rank", (F.col("_before") + place).cast("int")).withColumn("n_terms", F.col("_n")).select(*df.columns, "term_rank", "n_terms")
    else:
        out = df.withColumn("term_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("n_terms", F.count("*").over(Window.partitionBy(*by)))
    return out.withColumn("percentile", F.when(F.col("n_terms") <= 1, F.lit(0.0)).otherwise((F.col("term_rank") - 1) / (F.col("n_terms") - 1) * 100))


def cumulative_share(df: DataFrame, value: str, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """Adds cum_share: the running share of value within `by`."""
    w = Window.partitionBy(*by)
    run = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("cum_share", F.sum(value).over(run) / F.sum(value).over(w))


def first_over(df: DataFrame, value: str, threshold: float, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """(by, n_needed): how many rows in order reach the threshold share."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    c = cumulative_share(df.withColumn("_n", n), value, by, *order)
    return c.where(F.col("cum_share") >= threshold).groupBy(*by).agg(F.min("_n").alias("n_needed"))


def ratio_argmax(df: DataFrame, value: str, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """(by, k): the place (from 1) at which value over the next value is largest; the first of equals."""
    w = Window.partitionBy(*by).orderBy(*order)
    r = df.withColumn("_r", F.try_divide(F.col(value), F.lead(value).over(w))).withColumn("_n", F.row_number().over(w)).where("_r IS NOT NULL")
    return r.groupBy(*by).agg(F.max_by("_n", F.struct("_r", -F.col("_n"))).alias("k"))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same ones every time: the first by hash of key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def balanced_take(df: DataFrame, by: str, is_control: Column, n: int, *order: Column | str) -> DataFrame:
    """Up to n rows of each `by`, controls first up to half (rounded up), the rest from others; a shortfall on one side is filled from the other."""
    d = df.withColumn("_c", is_control)
    sizes = Window.partitionBy(by)
    c, o = F.count_if("_c").over(sizes), F.count_if(~F.col("_c")).over(sizes)
    half = F.lit(-(-n // 2))
    controls = F.least(c, F.greatest(half, F.lit(n) - o))
    quota = F.when(F.col("_c"), controls).otherwise(F.least(o, F.lit(n) - controls))
    d = d.withColumn("_q", quota).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_c").orderBy(*order)))
    return d.where("_n <= _q").drop("_c", "_q", "_n")


def chunks(df: DataFrame, size: int, by: tuple[str, ...], *order: Column | str) -> DataFrame:
    """Adds chunk: floor((place - 1) / size) within `by`."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("chunk", F.floor((n - 1) / size).cast("long"))


def union_length(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """(key, length): length of the union of half-open intervals."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return df.withColumn("_g", gain).groupBy(key).agg(F.sum("_g").alias("length"))
