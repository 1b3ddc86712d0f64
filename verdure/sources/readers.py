"""Readers of the file forms of an expression compendium, each to a long or fixed frame."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.functions.text import locus


def _cells(line: Column, sep: str) -> Column:
    """The cells of a line; separators within quotes are kept, quotes around a cell go and doubled ones inside are one."""
    one = f"(?:[^{sep}]*)" if sep != "\t" else "(?:[^\t]*)"
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{sep}(\\s*"(?:[^"]|"")*"\\s*|{one})'), 1)
    bare = F.transform(quoted, lambda x: F.when(F.btrim(x).startswith('"'), F.replace(F.regexp_replace(F.btrim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(line.contains('"'), bare).otherwise(F.split(line, f"\\Q{sep}\\E"))


def wide_csv(spark: SparkSession, path: str | list[str], sep: str = ",", gene: str | None = None, drop: tuple[str, ...] = (), samples: tuple[str, ...] | None = None) -> DataFrame:
    """(gene_id, sample_id, value) of matrix files with genes down and samples across, each by its own header; without a column a sample: lines are split against it.

    gene: the name of the gene column (an error where a file has none), else the first. samples: of other columns no cell is looked at. A sample is
    named by its column up to the first dot. Long files are read by many tasks; the headers are found in a first pass that splits nothing.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(meta["file_path"].alias("_f"), meta["file_block_start"].alias("_o"), F.monotonically_increasing_id().alias("_i"), "value")
    names = _cells(F.col("header"), sep)
    heads = raw.where("_o = 0").groupBy("_f").agg(F.min_by("value", "_i").alias("header"), F.min("_i").alias("_h"))
    place = F.when(F.array_position(names, gene) > 0, F.array_position(names, gene).cast("int") - 1).otherwise(F.raise_error(F.concat(F.lit(f"no column {gene} in "), "_f")).cast("int")) if gene else F.lit(0)
    heads = heads.select("_f", "_h", place.alias("_at"), F.transform(names, lambda n, k: F.struct(k.alias("k"), n.alias("column"), F.split_part(n, F.lit("."), F.lit(1)).alias("n"))).alias("_c"))
    kept = lambda x: (x["k"] != F.col("_at")) & ~x["column"].isin(*drop) & (x["n"].isin(*samples) if samples is not None else F.lit(True))
    heads = heads.select("_f", "_h", "_at", F.filter("_c", kept).alias("_c"))
    body = raw.join(heads, "_f").where("_o <> 0 OR _i <> _h").select("_at", "_c", _cells(F.col("value"), sep).alias("_v"))
    cell = F.explode(F.transform("_c", lambda x: F.struct(x["n"].alias("sample_id"), F.get("_v", x["k"]).alias("v")))).alias("x")
    return body.select(F.get("_v", F.col("_at")).alias("gene_id"), cell).select("gene_id", "x.sample_id", F.col("x.v").try_cast("double").alias("value"))


def header_columns(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names from the first line alone."""
    row = spark.read.text(path).limit(1).first()
    return [x.strip('"') for x in row[0].split(sep)] if row else []


def sniffed_counts(spark: SparkSession, path: str, rows: int = 100, least: float = 2) -> DataFrame:
    """A counts file (gz or plain): separator by the first line (a tab if tabs are not fewer than commas), # lines and __ genes left out; refused when empty, flat or short."""
    first = spark.read.text(path).where("NOT startswith(value, '#')").limit(1).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    sep = "\t" if first[0].count("\t") >= first[0].count(",") else ","
    df = spark.read.csv(path, sep=sep, comment="#", header=True, inferSchema=True)
    gene, *rest = [f for f in df.schema if True]
    nums = [f.name for f in rest if isinstance(f.dataType, T.NumericType)]
    if not nums:
        raise ValueError(f"{path} has no numbers")
    long = df.where(~F.col(gene.name).startswith("__")).unpivot(gene.name, nums, "sample_id", "value").toDF("gene_id", "sample_id", "value").withColumn("value", F.col("value").cast("double"))
    seen = long.agg(F.max("value").alias("top"), F.countDistinct("gene_id").alias("n")).first()
    if seen.top is None or seen.top < least or seen.n < rows:
        raise ValueError(f"{path} does not look like counts")
    return long


def salmon_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """TPM files: locus from gene_id, gene_name left out; rows without a locus go."""
    return wide_csv(spark, path, "\t", "gene_id", ("gene_name",)).withColumn("gene_id", locus(F.col("gene_id"))).where("gene_id IS NOT NULL")


def directory_study(depth: int = 1) -> Column:
    """The name of the folder `depth` above a row's file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.element_at(parts, F.lit(-1 - depth))


def study_tree(spark: SparkSession, glob: str, sep: str = "\t") -> DataFrame:
    """(study_id, line) of all files of a glob, study by folder; unreadable files are passed over."""
    df = spark.read.option("ignoreCorruptFiles", "true").text(glob)
    return df.select(directory_study().alias("study_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, go_id): locus codes in a gene association file's synonyms."""
    df = spark.read.csv(path, sep="\t", comment="!")
    genes = F.explode(F.split(F.concat_ws("|", "_c10", "_c2", "_c9"), r"\|"))
    return df.select(F.col("_c4").alias("go_id"), genes.alias("s")).select(locus(F.col("s")).alias("gene_id"), "go_id").where("gene_id IS NOT NULL").distinct()


def obo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(terms (go_id, name, namespace), edges (child, parent)) of an OBO file, stanza by stanza; obsolete terms go."""
    s = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("[Term]") & ~F.col("value").contains("is_obsolete: true"))
    one = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (\S.*)$", 1)
    terms = s.select(one("id").alias("go_id"), one("name").alias("name"), one("namespace").alias("namespace"))
    edges = s.select(one("id").alias("child"), F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1))).alias("parent"))
    return terms, edges


def gtf_exons(spark: SparkSession, path: str) -> DataFrame:
    """(gene_id, start, end): exons, half open from 0."""
    df = spark.read.csv(path, sep="\t", comment="#", quote="")
    gene = F.regexp_extract("_c8", r'gene_id "([^"]+)"', 1)
    return df.where("_c2 = 'exon' AND _c8 IS NOT NULL").select(gene.alias("gene_id"), (F.col("_c3").cast("long") - 1).alias("start"), F.col("_c4").cast("long").alias("end")).where("gene_id <> ''")


def gff_with_gene_ids(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a GFF3 file; those without gene_id get one from Parent or ID, the part before a dot."""
    parent = F.nullif(F.regexp_extract("value", r"Parent=([^;.\s]+)", 1), F.lit(""))
    own = F.nullif(F.regexp_extract("value", r"ID=([^;.\s]+)", 1), F.lit(""))
    add = F.concat(F.regexp_replace("value", r";?\s*$", ""), F.lit(";gene_id="), F.coalesce(parent, own, F.lit("unassigned_gene")))
    keep = F.col("value").startswith("#") | F.col("value").contains("gene_id=") | (F.size(F.split("value", "\t")) < 9)
    return spark.read.text(path).select(F.when(keep, F.col("value")).otherwise(add).alias("value"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a list parted by commas or lines, first occurrence of each."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"[,\r\n]+")).alias("pos", "id")).select("pos", F.trim("id").alias("id")).where("id <> ''")
    return raw.groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id")


def annotation_locus(df: DataFrame, order: tuple[str, ...] = ("ORF", "AGI", "Locus", "Locus_id", "Gene Symbol", "GENE_SYMBOL", "SYMBOL")) -> Column:
    """The locus column of a platform table: the first of these it has; the part before /// and //."""
    name = next((c for c in order if c in df.columns), None)
    if name is None:
        raise ValueError("no locus column")
    return F.trim(F.split_part(F.split_part(F.col(f"`{name}`"), F.lit("///"), F.lit(1)), F.lit("//"), F.lit(1)))


def label_documents(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """(path, sample_id, axis, label, intensity) of label JSON files: {sample: {axis: values}}, [{id, axis...}] or [{sample: {...}}]; broken files give no rows."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if skip:
        files = files.where(~F.col("path").contains(skip))
    doc = files.withColumn("v", F.expr("try_parse_json(value)")).where("v IS NOT NULL")
    text = F.col("v").cast("string")
    as_map = F.from_json(text, "map<string,string>")
    entries = doc.withColumn("items", F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.from_json(text, "array<map<string,string>>")).otherwise(F.array(as_map)))
    one = entries.select("path", F.explode("items").alias("m"))
    key = F.coalesce(*[F.col("m")[k] for k in ("id", "sample_id", "name", "run", "sample")])
    flat = one.where(key.isNotNull()).select("path", F.upper(key).alias("sample_id"), F.map_filter("m", lambda k, _: ~k.isin("id", "sample_id", "name", "run", "sample")).alias("axes"))
    nested = one.where(key.isNull()).select("path", F.explode("m").alias("sample_id", "s")).select("path", F.upper("sample_id").alias("sample_id"), F.from_json("s", "map<string,string>").alias("axes"))
    long = flat.unionByName(nested).where("axes IS NOT NULL").select("path", "sample_id", F.explode("axes").alias("axis", "s"))
    many = F.when(F.col("s").startswith("["), F.from_json("s", "array<string>")).otherwise(F.array("s"))
    each = long.select("path", "sample_id", "axis", F.explode(many).alias("x"))
    obj = F.from_json("x", "struct<val:string,value:string,intensity:string>")
    is_obj = F.col("x").startswith("{")
    return each.select("path", "sample_id", "axis", F.when(is_obj, F.coalesce(obj["val"], obj["value"])).otherwise(F.col("x")).alias("label"), F.when(is_obj, obj["intensity"].try_cast("int")).alias("intensity"))


def metadata_platform(df: DataFrame, text: str = "value") -> DataFrame:
    """(sample_id, platform) of sample metadata JSON; of a list the first, 'unspecified' for none."""
    p = F.get_json_object(text, "$.platform")
    first = F.when(p.startswith("["), F.get_json_object(text, "$.platform[0]")).otherwise(p)
    return df.select(F.get_json_object(text, "$.sample_id").alias("sample_id"), F.coalesce(F.nullif(first, F.lit("")), F.lit("unspecified")).alias("platform"))


def coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    """(sample, percent): the study prefix off the key, bad numbers 0."""
    df = spark.read.csv(path, header=True)
    return df.select(F.regexp_replace("Sample", r"^GSE\d+_", "").alias("sample"), F.coalesce(F.col("Percent_Mapped").try_cast("double"), F.lit(0.0)).alias("percent"))


# Fixed values of the tracker files: the code in a study's file and its state.
STATUS = {0: "not_tried", 1: "downloaded", 2: "processed", 3: "ignore", 4: "error", 5: "semi_processed"}


def tracker_statuses(spark: SparkSession, glob: str) -> DataFrame:
    """(study_id, code, state): one GSE*.txt file a study, with a code or the name of a state; side files are left out, other contents are 'unknown'."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.text(glob, wholetext=True).select(name.alias("name"), F.trim(F.regexp_replace("value", r"\s+", " ")).alias("raw"))
    files = files.where("name RLIKE '^GSE.*[.]txt$' AND NOT name RLIKE '_(meta|ecotype|missing_samples)'").select(F.regexp_replace("name", r"\.txt$", "").alias("study_id"), F.col("raw").try_cast("int").alias("code"), "raw")
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    said = F.when(F.col("raw").isin(*STATUS.values()), F.col("raw"))
    return files.select("study_id", "code", F.coalesce(F.try_element_at(names, F.col("code")), said, F.lit("unknown")).alias("state"))


def log_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(task, line_no, line) of job logs named ..._<task>.txt."""
    df = spark.read.text(glob, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"_(\d+)\.txt$", 1).try_cast("int").alias("task"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return df


def failing_samples(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct samples named in failed-process lines."""
    s = F.regexp_extract(line, r"Error executing process\s*>\s*'[^']*\(([^)]+)\)'", 1)
    return lines.select(s.alias("sample")).where("sample <> ''").distinct()


def required(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has these columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_of_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def capped(m: DataFrame, genes: int, samples: tuple[str, ...]) -> DataFrame:
    """The first `genes` genes by name, of the named samples: for a look at a large matrix."""
    few = m.select("gene_id").distinct().orderBy("gene_id").limit(genes)
    return m.where(F.col("sample_id").isin(*samples)).join(few, "gene_id", "left_semi")


def curated(spark: SparkSession, path: str, source: str = "GEO", species: str = "Arabidopsis thaliana") -> DataFrame:
    """(accession) of a curated list's rows of one depository and species."""
    return spark.read.csv(path, header=True).where((F.col("depository_source") == source) & (F.col("species") == species)).select("accession")


def results(spark: SparkSession, paths: dict[str, str], columns: tuple[str, ...], name: str) -> DataFrame:
    """Result tables in one, with the name each goes by; those that are absent or lack a column are passed over with a warning."""
    parts = []
    for key, path in paths.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            warnings.warn(f"{path} is absent", stacklevel=2)
            continue
        df = spark.read.parquet(path)
        if missing := [c for c in columns if c not in df.columns]:
            warnings.warn(f"{path} has no {', '.join(missing)}", stacklevel=2)
            continue
        parts.append(df.select(F.lit(key).alias(name), *columns))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (name, *columns)]))
    return reduce(DataFrame.unionByName, parts)
