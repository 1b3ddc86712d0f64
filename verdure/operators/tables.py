"""Joins, set operations, trackers and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backfill(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str = "Unknown_Study", out: str | None = None) -> DataFrame:
    """Left join of lookup (key, value), default where it has none; of several values of a key the least."""
    found = df.join(lookup.groupBy(key).agg(F.min(value).alias("_v")), key, "left")
    return found.withColumn(out or value, F.coalesce(F.col("_v").cast("string"), F.lit(default))).drop("_v")


def two_hop(df: DataFrame, first: DataFrame, second: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """df with c by a -> b -> c; rows without a full path go."""
    return df.join(first.select(a, b), a).join(second.select(b, c), b)


def substring_class(df: DataFrame, classes: DataFrame, key: str, name: str, label: str, order: str) -> DataFrame:
    """df with label: of the class whose upper-cased name equals key, else of the first (by order) of which one holds the other, else NULL. The classes are a small dimension and are compared with each distinct key."""
    k = F.upper(F.col(key))
    keys = df.select(key).distinct()
    n = F.upper(F.col(name))
    hit = keys.join(F.broadcast(classes.select(name, label, order)), k.contains(n) | n.contains(k))
    best = hit.groupBy(key).agg(F.min_by(label, F.struct((k != n).alias("x"), F.col(order))).alias(label))
    return df.join(best, key, "left")


def prefix_owner(df: DataFrame, owners: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, prefix): the first owner (smallest) that key begins with, by an equi-join on prefixes of the owners' lengths."""
    lengths = [r[0] for r in owners.select(F.length(prefix)).distinct().collect()]
    if not lengths:
        return df.select(key, F.lit(None).cast("string").alias(prefix))
    cut = df.withColumn("_p", F.explode(F.array_distinct(F.array(*[F.substring(key, 1, n) for n in sorted(lengths)]))))
    hit = cut.join(owners.select(F.col(prefix).alias("_p")).distinct(), "_p").groupBy(key).agg(F.min("_p").alias(prefix))
    return df.select(key).distinct().join(hit, key, "left")


def matched_controls(df: DataFrame, treated: Column, control: Column, study: str) -> DataFrame:
    """Control rows of studies that have a treated row."""
    return df.where(control).join(df.where(treated).select(study).distinct(), study, "left_semi")


def percent_change(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base, other, change): rows in both; change in percent, NULL where the base is 0; extreme if over 500 either way."""
    both = base.select(key, F.col(value).alias("base")).join(other.select(key, F.col(value).alias("other")), key)
    change = F.try_divide(F.col("other") - F.col("base"), F.col("base")) * 100
    return both.withColumn("change", change).withColumn("extreme", F.abs("change") > 500)


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, in_a, in_b): the union of keys."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full").select(key, F.coalesce("_a", F.lit(False)).alias("in_a"), F.coalesce("_b", F.lit(False)).alias("in_b"))


def set_jaccard(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, jaccard) of all pairs of groups a < b that share an item; groups are few, items many."""
    m = members.select(group, item).distinct()
    size = m.groupBy(group).agg(F.count("*").alias("n"))
    x, y = m.select(F.col(group).alias("a"), item), m.select(F.col(group).alias("b"), item)
    both = x.join(y, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    both = both.join(size.select(F.col(group).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(group).alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reconcile(memory: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Full outer join of tracked states and what files show (processed, downloaded flags): state by files first; changed if that differs."""
    state = F.when(F.coalesce("processed", F.lit(False)), "processed").when(F.coalesce("downloaded", F.lit(False)), "downloaded").otherwise(F.col("state"))
    both = memory.select(key, "state").join(files.select(key, "processed", "downloaded"), key, "full")
    return both.select(key, state.alias("new_state"), (~state.eqNullSafe(F.col("state"))).alias("changed"))


def crosstab(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Counts of col's values by row; 0 where there is none."""
    return df.groupBy(row).pivot(col, values).count().fillna(0)


def top_counts(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def demux(merged: DataFrame, owner: DataFrame, sample: str, study: str, path: str) -> None:
    """Write merged rows to a folder a study."""
    merged.join(owner.select(sample, study), sample).write.mode("overwrite").partitionBy(study).parquet(path)


def guarded_fold(events: DataFrame, key: str, state: str, priority: dict[str, int], *order: str) -> DataFrame:
    """(key, state, n): the last state in order, but no state overwrites one of a higher priority: the last among those of the highest priority seen."""
    p = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col(state)]
    known = events.withColumn("_p", p).where("_p IS NOT NULL")
    return known.groupBy(key).agg(F.max_by(state, F.struct("_p", *order)).alias(state), F.count("*").alias("n"))


def first_winner(df: DataFrame, key: str, value: str, source: str, *order: str) -> DataFrame:
    """(key, value, sources): the first value of a key wins; sources hold all it came from."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value), F.array_sort(F.collect_set(source)).alias("sources"))


def best_by(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(keys, value): the largest value, where it stands first."""
    return df.groupBy(*keys).agg(F.max(value).alias(value))
