"""Where labels, label maps, batches of counts and reviews are kept: a folder a study or an axis, a line a sample, so that no study or label is one large document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.sources.durable import exists

LABELS, SEEN = "axis string, raw string, label string", "axis string, raw string, study_id string, sample_id string"
REVIEWS = "username string, study_id string, sample_id string, label_scores string, comments string"
UNKNOWN_USER = "unknown_legacy_user"
#: What a coverage table says where nothing is known.
UNSPECIFIED = "unspecified"


def write_labels(labels: DataFrame, path: str) -> None:
    """(study_id, sample_id, axis, label) as JSON lines {"id", axis: [labels in order]}, a folder a study; repeated labels once, null labels not at all (an axis of none is an empty list)."""
    each = labels.groupBy("study_id", "sample_id", "axis").agg(F.array_sort(F.collect_set("label")).alias("l"))
    axes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "l"))))
    line = each.groupBy("study_id", "sample_id").agg(F.to_json(axes).alias("j"))
    own = F.regexp_replace(F.to_json(F.struct(F.col("sample_id").alias("id"))), r"\}$", "")
    text = F.concat(own, F.when(F.col("j") == "{}", "}").otherwise(F.concat(F.lit(","), F.substr("j", F.lit(2)))))
    line.select("study_id", text.alias("value")).repartition("study_id", F.pmod(F.xxhash64("value"), F.lit(8))).write.mode("overwrite").partitionBy("study_id").text(path)


def condensed(spark: SparkSession, path: str) -> DataFrame:
    """(study_id, id, axis, label) of all studies written by write_labels; an axis without labels has one row of null, a line that is no object none."""
    lines = spark.read.schema("value string, study_id string").text(path)
    m = lines.select("study_id", F.get_json_object("value", "$.id").alias("id"), F.from_json("value", "map<string,string>").alias("m")).where("id IS NOT NULL")
    axes = m.select("study_id", "id", F.explode(F.map_filter("m", lambda k, _: k != "id")).alias("axis", "v"))
    return axes.select("study_id", "id", "axis", F.explode_outer(F.from_json("v", "array<string>")).alias("label"))


def single_pairs(raw: DataFrame, grounded: DataFrame) -> DataFrame:
    """(study_id, sample_id, axis, raw, grounded) where a sample has one raw and one grounded label of an axis; with more, none can be told to belong to which.

    Both are (study_id, sample_id, axis, label). Equal labels count each, a null label doesn't count.
    """
    key = ["study_id", "sample_id", "axis"]
    one = lambda d, n: d.where("label IS NOT NULL").groupBy(*key).agg(F.count("*").alias("n"), F.first("label").alias(n)).where("n = 1").drop("n")
    return one(raw, "raw").join(one(grounded, "grounded"), key)


def load_map(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(LABELS, SEEN) of a label map; empty where nothing is saved yet."""
    at = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").select(*[c.split()[0] for c in schema.split(", ")]) if exists(spark, f"{path}/{name}") else spark.createDataFrame([], schema)
    return at("labels", LABELS), at("seen", SEEN)


def add_pairs(labels: DataFrame, seen: DataFrame, pairs: DataFrame, axes: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The map with pairs (study_id, sample_id, axis, raw, grounded, at) of the named axes. A raw label keeps the label it has, else takes that of the least `at` (of equal ones
    the smaller label); each study and sample it was met in is kept once, a null sample not, a study met without samples with a null one."""
    new = pairs.where(F.col("axis").isin(*axes) & F.col("raw").isNotNull() & F.col("grounded").isNotNull())
    first = new.groupBy("axis", "raw").agg(F.min_by("grounded", F.struct("at", "grounded")).alias("label"))
    out = labels.unionByName(first.join(labels, ["axis", "raw"], "left_anti"))
    met = seen.unionByName(new.where("study_id IS NOT NULL").select("axis", "raw", "study_id", "sample_id")).distinct()
    named = met.where("sample_id IS NOT NULL")
    bare = met.where("sample_id IS NULL").join(named, ["axis", "raw", "study_id"], "left_anti")
    return out, named.unionByName(bare.select(*named.columns))


def save_map(labels: DataFrame, seen: DataFrame, path: str) -> None:
    """Both tables, a folder an axis. Not over the files they are read from: save to a new path."""
    for name, df in (("labels", labels), ("seen", seen)):
        df.write.mode("errorifexists").partitionBy("axis").parquet(f"{path}/{name}")


def write_batch(counts: DataFrame, tpm: DataFrame | None, owner: DataFrame, meta: DataFrame, path: str, batch_id: str | None, origin: str, at: str) -> DataFrame:
    """A merged batch by study: counts, tpm (matrices), coverage (CSV with a header) and batch (JSON lines), each a folder a study. Gives (study_id, n_samples) of what was saved.

    owner: (sample_id, study_id); a sample of two studies goes to both, one without a study nowhere, and a study none of whose samples were counted
    isn't saved. meta: (sample_id, json) of the mapping's own report; what it lacks, or all where it is broken or absent, is 'unspecified'.
    """
    owner = owner.select("sample_id", "study_id").dropna().distinct()
    found = counts.select("sample_id").distinct().join(owner, "sample_id")
    for name, m in (("counts", counts), ("tpm", tpm)):
        if m is not None:
            m.join(owner, "sample_id").write.mode("overwrite").partitionBy("study_id").parquet(f"{path}/{name}")
    v = F.try_parse_json("json")
    get = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(UNSPECIFIED))
    told = meta.groupBy("sample_id").agg(F.max("json").alias("json"))
    coverage = found.join(told, "sample_id", "left").select(
        F.col("sample_id").alias("Sample"), get("num_processed").alias("Total_Reads_Processed"), get("num_mapped").alias("Reads_Mapped"), get("percent_mapped").alias("Percent_Mapped"), F.lit(batch_id or "unknown").alias("Batch_ID"), "study_id"
    )
    coverage.write.mode("overwrite").partitionBy("study_id").csv(f"{path}/coverage", header=True)
    record = found.select("study_id", F.lit(batch_id or "unknown").alias("batch_id"), F.lit(origin).alias("origin"), F.col("sample_id").alias("sample"), F.lit(at).alias("at"))
    record.write.mode("overwrite").partitionBy("study_id").json(f"{path}/batch")
    return found.groupBy("study_id").agg(F.count("*").alias("n_samples"))


def metadata_of(spark: SparkSession, glob: str, samples: DataFrame) -> DataFrame:
    """(sample_id, path, json) for each of samples (sample_id): the first file by path whose name holds the id as a whole part (GSM12 isn't in GSM123); NULL without one, and where it is no JSON."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.option("wholetext", "true").text(glob).select(F.col("_metadata.file_path").alias("path"), F.explode(F.array_distinct(F.regexp_extract_all(name, F.lit(r"([A-Za-z]+[0-9]+|[0-9]+)"), F.lit(1)))).alias("sample_id"), F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("json"))
    first = files.groupBy("sample_id").agg(F.min_by(F.struct("path", "json"), "path").alias("x"))
    return samples.select("sample_id").distinct().join(first, "sample_id", "left").select("sample_id", "x.path", "x.json")


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """REVIEWS of a results CSV; a file from before users were noted gets UNKNOWN_USER, and no file gives no rows. A user left blank stays null."""
    if not exists(spark, path):
        return spark.createDataFrame([], REVIEWS)
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return df.select(*[_or(df, c, F.lit(UNKNOWN_USER) if c == "username" else F.lit(None).cast("string")) for c in ("username", "study_id", "sample_id", "label_scores", "comments")])


def _or(df: DataFrame, name: str, rest: Column) -> Column:
    return (F.col(name) if name in df.columns else rest).alias(name)


def payload(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entry) of a survey's JSON list, each entry a Variant; no rows where there is no file or it holds no list."""
    if not exists(spark, path):
        return spark.createDataFrame([], "pos int, entry string").select("pos", F.try_parse_json("entry").alias("entry"))
    return spark.read.option("wholetext", "true").text(path).select(F.posexplode(F.expr("CAST(try_variant_get(try_parse_json(value), '$', 'array<variant>') AS array<variant>)")).alias("pos", "entry"))
