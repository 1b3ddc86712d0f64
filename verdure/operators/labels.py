"""Labels of samples and studies: covariates and classes for normalisation, eligibility, scopes, comparison of two labellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def study_of(columns: DataFrame, owner: DataFrame, col: str = "column") -> DataFrame:
    """columns with study_id: by the map (sample_id, study_id) for the name without what follows a dot, else the part before the first _."""
    look = owner.groupBy(F.col("sample_id").alias("_s")).agg(F.min("study_id").alias("_o"))
    out = columns.withColumn("_s", F.split_part(col, F.lit("."), F.lit(1))).join(look, "_s", "left")
    return out.withColumn("study_id", F.coalesce("_o", F.split_part(col, F.lit("_"), F.lit(1)))).drop("_s", "_o")


def joined(values: Column, sep: str, missing: str) -> Column:
    """Values sorted and joined; `missing` for none."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.filter(values, lambda x: x.isNotNull() & (x != ""))), sep), F.lit("")), F.lit(missing))


def covariates(samples: DataFrame, labels: DataFrame, axes: tuple[str, ...], missing: str = "unknown") -> DataFrame:
    """(sample_id, axes...): of long labels (sample_id, axis, label), matched by upper-cased id, several of an axis sorted and joined by _."""
    each = labels.where(F.col("axis").isin(*axes)).groupBy(F.upper("sample_id").alias("_k"), "axis").agg(joined(F.collect_set("label"), "_", missing).alias("v"))
    wide = each.groupBy("_k").pivot("axis", list(axes)).agg(F.first("v"))
    out = samples.select("sample_id").distinct().withColumn("_k", F.upper("sample_id")).join(wide, "_k", "left")
    return out.select("sample_id", *[F.coalesce(a, F.lit(missing)).alias(a) for a in axes])


def unmatched(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample_id, near): samples without a label of their own upper-cased id, and the least labelled id of which one holds the other. Ids are compared within blocks of labelled ids, which are sent around as a dimension of a few thousand."""
    known = labels.select(F.upper("sample_id").alias("_k")).distinct()
    alone = samples.select("sample_id").distinct().withColumn("_k", F.upper("sample_id")).join(known, "_k", "left_anti")
    near = contains(alone, known, F.col("_k"), "_k", "near", both=True)
    return near.select("sample_id", "near")


def contains(df: DataFrame, names: DataFrame, text: Column, name: str, out: str, both: bool = False) -> DataFrame:
    """df with the least name that its text holds (both: or that holds the text), NULL for none; found by the pieces of the text of the names' lengths, by an equi-join, no name being compared with a text it shares no piece with."""
    n = names.select(F.col(name).alias("_n")).distinct()
    d = df.withColumn("_t", text).withColumn("_row", F.xxhash64("_t"))
    texts = d.select("_t").distinct()
    lengths = sorted(r[0] for r in n.select(F.length("_n")).distinct().collect() if r[0])
    pieces = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
    if not lengths:
        return d.withColumn(out, F.lit(None).cast("string")).drop("_t", "_row")
    hit = texts.select("_t", F.explode(F.array_distinct(F.flatten(F.array(*[pieces(F.col("_t"), k) for k in lengths])))).alias("_n")).join(n, "_n")
    if both:
        sizes = sorted(r[0] for r in texts.select(F.length("_t")).distinct().collect() if r[0])
        if sizes:
            hit = hit.unionByName(n.select("_n", F.explode(F.array_distinct(F.flatten(F.array(*[pieces(F.col("_n"), k) for k in sizes])))).alias("_t")).join(texts, "_t").select("_n", "_t"))
    best = hit.groupBy("_t").agg(F.min("_n").alias(out))
    return d.join(best, "_t", "left").drop("_t", "_row")


def class_labels(labels: DataFrame, axes: tuple[str, ...] = ("treatment", "tissue"), missing: str = "Unspecified") -> DataFrame:
    """(sample_id, class): each axis's labels sorted and joined by -, the axes by _."""
    each = labels.groupBy("sample_id").pivot("axis", list(axes)).agg(F.collect_set("label"))
    return each.select("sample_id", F.concat_ws("_", *[joined(F.coalesce(a, F.array().cast("array<string>")), "-", missing) for a in axes]).alias("class"))


def in_scope(c: Column, scope: str | None) -> Column:
    """Whether a label is there and holds the scope; None: whether it is there."""
    return c.isNotNull() if scope is None else F.coalesce(c.contains(scope), F.lit(False))


def without_singletons(df: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Rows of classes that have `least` rows at least."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(by))).where(F.col("_n") >= least).drop("_n")


# Fixed values of run tables: instruments and strategies whose reads can't be quantified here.
BAD_INSTRUMENT = "solid|ab solid|colorspace"
BAD_STRATEGY = ("CAGE", "RAMPAGE", "ChIP-Seq", "ATAC-seq", "AMPLICON")


def incompatible(runs: DataFrame, study: str = "study_id", run: str = "run", instrument: str = "instrument", strategy: str = "strategy") -> DataFrame:
    """(study, run, reason): the first run (by name) of each study that can't be used."""
    reason = F.when(F.lower(instrument).rlike(BAD_INSTRUMENT), "instrument").when(F.col(strategy).isin(*BAD_STRATEGY), "strategy")
    bad = runs.withColumn("reason", reason).where("reason IS NOT NULL")
    return bad.groupBy(study).agg(F.min(run).alias(run), F.min_by("reason", run).alias("reason"))


def eligible(samples: DataFrame, study: str = "study_id", kind: str = "kind", raw: str = "has_raw", least: int = 5) -> DataFrame:
    """(study, n): studies of one kind with raw data and `least` samples at least."""
    s = samples.groupBy(study).agg(F.count("*").alias("n"), F.countDistinct(kind).alias("_k"), F.max(raw).alias("_r"))
    return s.where((F.col("n") >= least) & (F.col("_k") == 1) & F.col("_r")).select(study, "n")


def cleaned_cache(cache: DataFrame, prefix: str = "GSM") -> DataFrame:
    """A map (key, values array) without values of the prefix; keys left with none go."""
    return cache.withColumn("values", F.filter("values", lambda x: ~x.startswith(prefix))).where(F.size("values") > 0)


def matched(labels: DataFrame, ids: DataFrame, key: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """(the first label row of each id that is in ids, a row a mismatch: key and side)."""
    first = labels.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    have, want = labels.select(key).distinct(), ids.select(key).distinct()
    off = have.join(want, key, "left_anti").withColumn("side", F.lit("label only")).unionByName(want.join(have, key, "left_anti").withColumn("side", F.lit("matrix only")))
    return first.join(want, key, "left_semi"), off


def sorted_by(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """df in a fixed order of categories; others after these, by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return df.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), col)


def gene_sets(annotation: DataFrame, terms: DataFrame, gene: str = "gene_id", term: str = "go_id", name: str = "name") -> DataFrame:
    """(set, genes): 'GO (name)' and the sorted genes of each term that is named."""
    return annotation.join(terms.select(term, name), term).groupBy(F.concat(F.col(term).cast("string"), F.lit(" ("), F.col(name), F.lit(")")).alias("set")).agg(F.array_sort(F.collect_set(gene)).alias("genes"))


def union_size(df: DataFrame, by: str, genes: str, sep: str = ";") -> DataFrame:
    """(by, n): distinct names in lists joined by sep."""
    each = df.select(by, F.explode(F.split(genes, sep)).alias("_g")).where("trim(_g) <> ''")
    return each.groupBy(by).agg(F.countDistinct(F.trim("_g")).alias("n"))


def hits_per_method(df: DataFrame, by: str, hit: str) -> DataFrame:
    """(by, hits, n, share)."""
    return df.groupBy(by).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).withColumn("share", F.col("hits") / F.col("n"))


def canonical(values: Column) -> Column:
    """A form in which two lists of labels compare: lower case, trimmed, sorted, each once."""
    return F.array_sort(F.array_distinct(F.transform(values, lambda x: F.lower(F.trim(x)))))


def change_of(a: Column, b: Column) -> Column:
    """Of two arrays of structs (val, intensity): same, intensity_only, val_only or both_changed."""
    val = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda t: F.lower(t["val"]))))
    pair = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda t: F.concat_ws("|", F.lower(t["val"]), t["intensity"].cast("string")))))
    strength = lambda x: F.array_sort(F.transform(x, lambda t: t["intensity"]))
    return F.when(pair(a) == pair(b), "same").when(val(a) == val(b), "intensity_only").when(strength(a) == strength(b), "val_only").otherwise("both_changed")


def readable(treatments: Column) -> Column:
    """Of an array of structs (val, intensity): a+b [i=1,2], names sorted."""
    t = F.array_sort(treatments)
    return F.concat(F.array_join(F.transform(t, lambda x: x["val"]), "+"), F.lit(" [i="), F.array_join(F.transform(t, lambda x: x["intensity"].cast("string")), ","), F.lit("]"))


def exclusive_state(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """(key, state): adding a key to one state takes it from the others, so the last event holds."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))
