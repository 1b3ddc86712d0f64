"""Report tables: label divergence, weights of axes, terms across configurations, screens of studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.operators.matrix import noise_filter, with_scalar

#: Words that tell of fractions a bulk pipeline can't take, each matched as a whole word in small letters.
RED_FLAGS = [
    "small rna", "srna", "mirna", "microrna", "trf", "trna-derived", "pirna", "snrna", "scrna", "ncrna", "non-coding",
    "ribo-seq", "ribosome profiling", "translatome",
    "scrna-seq", "snrna-seq", "single-cell", "single-nucleus", "10x genomics", "spatial transcriptomics",
    "cage-seq", "cage", "degradome", "pare-seq",
    "clip-seq", "rip-seq", "eclip", "iclip",
]
#: What a supplement's address holds if it may be a count matrix; the prior of axis weights.
COUNT_MARKS = (".txt", ".csv", ".tsv", ".tab", ".xlsx", "counts", "abundance", "fpkm", "tpm", ".tar")
AXIS_PRIOR = {"tissue": 2.307, "developmental_stage": 1.900, "treatment": 0.790, "ecotype": 1.066, "modification": 0.503, "medium": 0.217, "treatment_intensity": 0.217}
#: Metrics that make the weight of an axis.
AXIS_METRICS = ("multinomial_logistic_accuracy", "KNN_Purity", "Silhouette")


def label_differences(one: DataFrame, two: DataFrame, treatment: str = "treatment") -> DataFrame:
    """(study_id, sample_id, axis, v1, v2, kind) of samples in both of (study_id, sample_id, axis, items of val and intensity), where they differ.

    Names are compared as sorted, distinct, small letters. An axis counts only if the first side says something; the treatment axis counts either way, as
    val_only, intensity_only or both_changed, by its names and its pairs of name and intensity.
    """
    key = ["study_id", "sample_id"]
    both = one.select(*key).distinct().join(two.select(*key).distinct(), key)
    say = lambda d, n: d.join(both, key, "left_semi").groupBy(*key, "axis").agg(F.flatten(F.collect_list("items")).alias(f"i{n}"))
    d = say(one, 1).join(say(two, 2), [*key, "axis"], "full")
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<struct<val: string, intensity: int>>")), lambda x: F.lower(F.btrim(x["val"])))))
    pairs = lambda c: F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<struct<val: string, intensity: int>>")), lambda x: F.struct(F.lower(F.btrim(x["val"])).alias("v"), F.coalesce(x["intensity"], F.lit(-1)).alias("n")))))
    word = lambda c: F.coalesce(F.nullif(F.array_join(names(c), " + "), F.lit("")), F.lit("unspecified"))
    a, b = F.col("i1"), F.col("i2")
    val, pair = names(a) != names(b), pairs(a) != pairs(b)
    only = F.array_sort(F.array_distinct(F.transform(pairs(a), lambda x: x["n"]))) == F.array_sort(F.array_distinct(F.transform(pairs(b), lambda x: x["n"])))
    split = F.when(val & pair & ~only, "both_changed").when(val, "val_only").when(pair, "intensity_only")
    kind = F.when(F.col("axis") == treatment, split).when((word(a) != word(b)) & (word(a) != "unspecified"), "changed")
    return d.select(*key, "axis", word(a).alias("v1"), word(b).alias("v2"), kind.alias("kind")).where("kind IS NOT NULL")


def divergence_by_study(one: DataFrame, two: DataFrame, differences: DataFrame) -> DataFrame:
    """(study_id, samples, diff_samples, conflict_rate, by_axis): common samples of each study, those that differ, and differences by axis."""
    key = ["study_id", "sample_id"]
    n = one.select(*key).distinct().join(two.select(*key).distinct(), key).groupBy("study_id").agg(F.count("*").alias("samples"))
    d = differences.groupBy("study_id").agg(F.countDistinct("sample_id").alias("diff_samples"))
    axes = differences.groupBy("study_id", "axis").agg(F.count("*").alias("n")).groupBy("study_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "n")))).alias("by_axis"))
    out = n.join(d, "study_id", "left").join(axes, "study_id", "left").withColumn("diff_samples", F.coalesce("diff_samples", F.lit(0)))
    return out.select("study_id", "samples", "diff_samples", (F.col("diff_samples") / F.col("samples")).alias("conflict_rate"), F.coalesce("by_axis", F.create_map().cast("map<string,bigint>")).alias("by_axis"))


def swaps(differences: DataFrame, top: int = 10) -> DataFrame:
    """(axis, v1, v2, n): the most frequent changes of each axis, by number and then by name."""
    n = differences.groupBy("axis", "v1", "v2").agg(F.count("*").alias("n"))
    best = n.groupBy("axis").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "v1", "v2"))), 1, top).alias("b"))  # distinct changes of an axis
    return best.select("axis", F.explode("b").alias("b")).select("axis", "b.v1", "b.v2", (-F.col("b.k")).alias("n"))


def axis_weights(metrics: DataFrame, alpha: float = 0.5, pseudocount: float = 0.05, prior: dict[str, float] | None = None) -> DataFrame:
    """(axis, weight) of metrics (axis, metric, value): the cube root of accuracy x purity x silhouette (0 at least) and a pseudocount, over its mean, drawn to the prior over its mean, over the mean of both.

    Axes without a prior, and priors without an axis, are left out. A metric that is missing throughout or for one axis is refused, as is no axis in common.
    """
    wide = metrics.groupBy("axis").pivot("metric", list(AXIS_METRICS)).agg(F.first("value"))
    told = wide.agg(F.count("*").alias("n"), *[F.count(m).alias(m) for m in AXIS_METRICS]).first()
    if missing := [m for m in AXIS_METRICS if not told[m]]:
        raise ValueError(f"missing metrics: {missing}")
    if any(told[m] < told.n for m in AXIS_METRICS):
        raise ValueError("missing metric values")
    prior = AXIS_PRIOR if prior is None else prior
    signal = F.cbrt(F.col(AXIS_METRICS[0]) * F.col(AXIS_METRICS[1]) * F.greatest(F.col(AXIS_METRICS[2]), F.lit(0.0))) + pseudocount
    s = wide.select("axis", signal.alias("s"))
    s = with_scalar(s, s.agg(F.avg("s").alias("ms"))).withColumn("p", F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])[F.col("axis")]).where("p IS NOT NULL")
    mean = s.agg(F.avg("p").alias("mp"), F.count("*").alias("n")).first()
    if not mean.n:
        raise ValueError("no axis has a prior")
    s = s.withColumn("w", alpha * F.col("s") / F.col("ms") + (1 - alpha) * F.col("p") / mean.mp)
    return with_scalar(s, s.agg(F.avg("w").alias("mw"))).select("axis", (F.col("w") / F.col("mw")).alias("weight"))


def terms_across(results: DataFrame, up: DataFrame, roots: DataFrame, config: tuple[str, ...], term: str = "go_id", fdr: str = "fdr") -> DataFrame:
    """(root, config..., the rest of the row, proxy, name): for each root and configuration its own row, else that of its descendant with the least fdr (then by term), which name and proxy tell."""
    down = roots.toDF("root").join(up, F.col("root") == F.col("ancestor")).select("root", F.col("node").alias(term)).join(results, term)
    rest = [c for c in results.columns if c not in (*config, term, fdr)]
    best = down.groupBy("root", *config).agg(F.min(F.struct((F.col(term) != F.col("root")).alias("proxy"), fdr, term, *rest)).alias("b"))
    name = F.concat(F.concat_ws(" ", *[F.col(c).cast("string") for c in config]), F.when(F.col("b.proxy"), " (proxy)").otherwise(""))
    return best.select("root", *config, "b.*", name.alias("name"))


def compared(results: DataFrame, keys: tuple[str, ...], pairs: list[tuple[str, dict, dict]], values: tuple[str, ...]) -> DataFrame:
    """(pair, keys..., value_a, value_b for each value) of terms in both configurations of each named pair (name, {column: value} of one, of the other)."""
    pick = lambda w, s: reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), w.items(), results).select(*keys, *[F.col(v).alias(f"{v}_{s}") for v in values])
    parts = [pick(a, "a").join(pick(b, "b"), list(keys)).select(F.lit(name).alias("pair"), "*") for name, a, b in pairs]
    return reduce(DataFrame.unionByName, parts)


def screened(studies: DataFrame, title: str = "title", summary: str = "summary", kind: str = "type", patterns: list[str] | None = None) -> DataFrame:
    """studies with status, matched and reason: flagged by words of RED_FLAGS, else by a type of non-coding RNA, else clean; no text at all is flagged for nothing."""
    low = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (title, summary, kind)]))
    found = F.filter(F.array(*[F.when(low.rlike(rf"\b{p}\b"), p) for p in (RED_FLAGS if patterns is None else patterns)]), lambda x: x.isNotNull())
    typed = F.lower(F.coalesce(F.col(kind), F.lit(""))).contains("non-coding rna")
    d = studies.withColumn("_f", found)
    some = F.size("_f") > 0
    d = d.withColumn("status", F.when(some | typed, "FLAGGED (HIGH RISK)").otherwise("CLEAN")).withColumn("matched", F.when(some, F.col("_f")).when(typed, F.array(F.lit("gdstype: non-coding"))).otherwise(F.array().cast("array<string>")))
    return d.withColumn("reason", F.when(some, F.concat(F.lit("words: "), F.array_join("_f", ", "))).when(typed, "type of non-coding RNA")).drop("_f")


def raw_data(metadata: DataFrame) -> DataFrame:
    """(study_id, has_cel, has_counts, has_sra) of metadata (study_id, level of study or sample, key, value): listed CEL files, supplements that look like counts, and reads told by a relation, an sra_id or a FASTQ supplement."""
    key, low = F.col("key"), F.lower("value")
    supplement, sample = key.contains("supplementary_file"), F.col("level") == "sample"
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    counts = reduce(lambda a, b: a | b, [low.contains(m) for m in COUNT_MARKS])
    reads = ((key == "relation") & (F.col("value").contains("SRA:") | F.col("value").contains("BioProject:"))) | (key == "sra_id") | (supplement & (low.contains(".fastq") | low.contains(".fq")))
    return metadata.groupBy("study_id").agg(any_of(sample & supplement & low.contains(".cel")).alias("has_cel"), any_of(supplement & counts).alias("has_counts"), any_of(sample & reads).alias("has_sra"))


def quiet_studies(m: DataFrame, above: float = 10.0, samples: int = 3, genes: int = 50, least: int = 2, study: str = "study_id") -> tuple[DataFrame, DataFrame]:
    """(m without genes that are noise within their study and without studies left with too little, (study, genes, samples, skipped))."""
    keyed = m.withColumn("_g", F.col("gene_id")).withColumn("gene_id", F.struct(study, "_g"))
    kept = noise_filter(keyed, above, samples).withColumn("gene_id", F.col("_g")).drop("_g")
    n = m.groupBy(study).agg(F.countDistinct("sample_id").alias("samples")).join(kept.groupBy(study).agg(F.countDistinct("gene_id").alias("genes")), study, "left").withColumn("genes", F.coalesce("genes", F.lit(0)))
    told = n.select(study, "genes", "samples", ((F.col("genes") < genes) | (F.col("samples") < least)).alias("skipped"))
    return kept.join(told.where("NOT skipped").select(study), study, "left_semi"), told


def control_counts(df: DataFrame, treated: Column, control: Column, study: str, treatment: str, threshold: int = 10) -> DataFrame:
    """(treatment, treated, controls, verdict) of df's treatments: how many controls stand in studies of their treated rows; skip without one, warn below the threshold, else ok."""
    t = df.where(treated).groupBy(treatment).agg(F.count("*").alias("treated"))
    where = df.where(treated).select(treatment, study).distinct()
    c = where.join(df.where(control).groupBy(study).agg(F.count("*").alias("k")), study).groupBy(treatment).agg(F.sum("k").alias("controls"))
    n = F.coalesce("controls", F.lit(0))
    return t.join(c, treatment, "left").select(treatment, "treated", n.alias("controls"), F.when(n == 0, "skip").when(n < threshold, "warn").otherwise("ok").alias("verdict"))


def recovery_grid(recovery: DataFrame, row: str, column: str, columns: list[str], threshold: float = 0.25) -> DataFrame:
    """(row, a column each): percentile with * where fdr is below the threshold and nes above 0, and PASS or FAIL beside it; 'absent' without a term."""
    good = (F.col("fdr") < threshold) & (F.col("nes") > 0)
    cell = F.when(F.col("percentile").isNull(), "absent").otherwise(F.concat(F.format_number("percentile", 1), F.when(good, "*").otherwise(""), F.when(good, " PASS").otherwise(" FAIL")))
    wide = recovery.groupBy(row).pivot(column, columns).agg(F.min(cell))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit("absent")).alias(c) for c in columns])


def bands(q: DataFrame, value: str = "value", by: str = "q") -> DataFrame:
    """(by, low, median, high): the 5th, 50th and 95th percentiles over samples of each percentile, or of each bin's density."""
    p = lambda s: F.percentile(value, F.lit(s))
    return q.groupBy(by).agg(p(0.05).alias("low"), p(0.5).alias("median"), p(0.95).alias("high"))


def expanded_labels(labels: DataFrame, runs: DataFrame, samples: DataFrame, axis: str = "label") -> DataFrame:
    """(sample_id, label) of all samples: the label of their own name in capitals, else that of the sample they are a run of, else 'unspecified'. labels (sample_id, label), runs (sample_id, run_id)."""
    own = labels.select(F.upper("sample_id").alias("k"), F.col(axis).alias("v")).groupBy("k").agg(F.min("v").alias("v"))
    of_run = runs.select(F.upper("run_id").alias("r"), F.upper("sample_id").alias("k")).join(own, "k").groupBy("r").agg(F.min("v").alias("w"))
    s = samples.select("sample_id", F.upper("sample_id").alias("k"))
    s = s.join(own, "k", "left").join(of_run.withColumnRenamed("r", "k"), "k", "left")
    return s.select("sample_id", F.coalesce("v", "w", F.lit("unspecified")).alias(axis))


def in_vocabulary(m: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(sample_id, values): each sample's values in the order of vocabulary (gene_id, pos), 0 for genes it lacks; genes outside go."""
    v = m.join(vocabulary, "gene_id").groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    size = vocabulary.agg(F.max("pos").alias("top"))
    return with_scalar(v, size).select("sample_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long")), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("values"))
