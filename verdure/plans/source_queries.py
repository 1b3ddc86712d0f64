"""Readers and sinks: each query writes files from a test table into the shared folder and reads them back by the library's reader."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdure.plans.matrix_queries import r
from verdure.plans.registry import query, t
from verdure.sources import readers, sinks
from verdure.storage import fresh


def lines(spark, df, what: str) -> str:
    """Path of a folder of text files that hold df's one column."""
    path = fresh(spark, what)
    df.write.text(path)
    return path


def tabbed(*cols):
    return F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cols]).alias("value")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
WIDE = "SELECT p_brand AS gene_id, p_type AS sample_id, round(sum(p_retailprice), 2) AS value FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD') GROUP BY 1, 2"


def wide_file(spark, sf) -> str:
    path = fresh(spark, "matrix")
    t(spark, sf, "part").groupBy("p_brand").pivot("p_type", TYPES).agg(r(F.sum("p_retailprice"), 2)).coalesce(1).write.csv(path, header=True)
    return path


@query("matrix_csv_scan", WIDE)
def _(spark, sf):
    return readers.wide_csv(spark, wide_file(spark, sf)).where("value IS NOT NULL")


@query("matrix_header_scan", "SELECT * FROM (VALUES (0, 'p_brand'), (1, 'ECONOMY'), (2, 'LARGE'), (3, 'MEDIUM'), (4, 'PROMO'), (5, 'SMALL'), (6, 'STANDARD')) v(pos, name)")
def _(spark, sf):
    return spark.createDataFrame(list(enumerate(readers.header_columns(spark, wide_file(spark, sf)))), "pos int, name string")


@query("matrix_capped_scan", f"WITH w AS ({WIDE}), g AS (SELECT DISTINCT gene_id FROM w ORDER BY 1 LIMIT 5) SELECT * FROM w WHERE gene_id IN (SELECT gene_id FROM g) AND sample_id IN ('LARGE', 'PROMO')")
def _(spark, sf):
    return readers.capped(readers.wide_csv(spark, wide_file(spark, sf)).where("value IS NOT NULL"), 5, ("LARGE", "PROMO"))


LOCUS = "upper('AT' || (1 + p_partkey % 5)::VARCHAR || 'G' || lpad(p_partkey::VARCHAR, 5, '0'))"


def locus_of(key: str = "p_partkey"):
    return F.concat(F.lit("at"), (1 + F.col(key) % 5).cast("string"), F.lit("g"), F.lpad(F.col(key).cast("string"), 5, "0"))


@query("salmon_tsv_scan", f"SELECT {LOCUS} AS gene_id, s AS sample_id, v::DOUBLE AS value FROM (SELECT p_partkey, unnest(['r1', 'r2']) AS s, unnest([p_size, p_retailprice]) AS v FROM part WHERE p_partkey % 3 <> 0)")
def _(spark, sf):
    p = t(spark, sf, "part")
    gene = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit("gene:"), locus_of(), F.lit(".1")))
    head = spark.createDataFrame([("gene_id\tgene_name\tr1\tr2",)], "value string")
    return readers.salmon_tsv(spark, lines(spark, head.union(p.select(tabbed(gene, "p_name", "p_size", "p_retailprice"))).coalesce(1), "tpm"))


@query("study_directory_scan", "SELECT 'study=' || o_orderstatus AS study_id, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "studies")
    t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderstatus").alias("study")).write.partitionBy("study").text(path)
    return readers.study_tree(spark, f"{path}/study=*").groupBy("study_id").agg(F.count("*").alias("n"), F.countDistinct("line").alias("keys"))


@query("count_file_sniff", "SELECT 'p' || p_partkey::VARCHAR AS gene_id, s AS sample_id, v::DOUBLE AS value FROM (SELECT p_partkey, unnest(['a', 'b']) AS s, unnest([p_size, p_size * 2]) AS v FROM part)")
def _(spark, sf):
    body = t(spark, sf, "part").select(tabbed(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_size", F.col("p_size") * 2))
    head, tail = (spark.createDataFrame([(x,)], "value string") for x in ("gene\ta\tb", "__no_feature\t9\t9"))
    return readers.sniffed_counts(spark, lines(spark, head.union(body).union(tail).coalesce(1), "counts"))


@query("sample_metadata_scan", "SELECT s_suppkey::VARCHAR AS sample_id, CASE s_suppkey % 3 WHEN 0 THEN 'GPL198' WHEN 1 THEN s_name ELSE 'unspecified' END AS platform FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey") % 3
    platform = F.when(k == 0, F.lit('"GPL198"')).when(k == 1, F.concat(F.lit('["'), "s_name", F.lit('", "other"]'))).otherwise(F.lit('""'))
    doc = F.concat(F.lit('{"sample_id": "'), F.col("s_suppkey").cast("string"), F.lit('", "platform": '), platform, F.lit("}")).alias("value")
    return readers.metadata_platform(spark.read.text(lines(spark, t(spark, sf, "supplier").select(doc), "metadata")))


@query("coverage_scan", "SELECT 'SRR' || c_custkey::VARCHAR AS sample, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_acctbal END AS percent FROM customer")
def _(spark, sf):
    path = fresh(spark, "coverage")
    c = t(spark, sf, "customer")
    c.select(F.concat(F.lit("GSE"), F.col("c_nationkey").cast("string"), F.lit("_SRR"), F.col("c_custkey").cast("string")).alias("Sample"), F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("Percent_Mapped")).write.csv(path, header=True)
    return readers.coverage_csv(spark, path)


@query("gaf_scan", f"SELECT DISTINCT {LOCUS} AS gene_id, 'GO:' || lpad(p_size::VARCHAR, 7, '0') AS go_id FROM part")
def _(spark, sf):
    go = F.concat(F.lit("GO:"), F.lpad(F.col("p_size").cast("string"), 7, "0"))
    body = t(spark, sf, "part").select(tabbed(F.lit("DB"), F.lit("id"), F.lit("sym"), F.lit(""), go, F.lit("ref"), F.lit("IEA"), F.lit(""), F.lit("P"), F.lit("name"), F.concat(F.lit("other|"), locus_of())))
    return readers.gaf(spark, lines(spark, spark.createDataFrame([("!gaf-version: 2.2",)], "value string").union(body), "gaf"))


@query("obo_scan", "SELECT 'GO:' || p_partkey::VARCHAR AS child, 'GO:' || (p_partkey // 2)::VARCHAR AS parent FROM part WHERE p_partkey > 0 AND p_partkey % 7 <> 0")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    dead = F.when(F.col("p_partkey") % 7 == 0, "is_obsolete: true\n").otherwise("")
    up = F.when(F.col("p_partkey") > 0, F.concat(F.lit("is_a: GO:"), F.expr("p_partkey div 2").cast("string"), F.lit(" ! up\n"))).otherwise("")
    return readers.obo(spark, lines(spark, t(spark, sf, "part").select(F.concat(F.lit("[Term]\nid: GO:"), k, F.lit("\nname: "), "p_name", F.lit("\nnamespace: p\n"), up, dead).alias("value")), "obo"))[1]


@query("gtf_exon_scan", "SELECT 'G' || (l_partkey % 50)::VARCHAR AS gene_id, l_orderkey - 1 AS start, l_orderkey + l_quantity::BIGINT AS \"end\" FROM lineitem WHERE l_linenumber % 2 = 1")
def _(spark, sf):
    kind = F.when(F.col("l_linenumber") % 2 == 1, "exon").otherwise("CDS")
    name = F.concat(F.lit('gene_id "G'), (F.col("l_partkey") % 50).cast("string"), F.lit('"; note "x"'))
    end = F.col("l_orderkey") + F.col("l_quantity").cast("long")
    return readers.gtf_exons(spark, lines(spark, t(spark, sf, "lineitem").select(tabbed(F.lit("1"), F.lit("src"), kind, "l_orderkey", end.cast("string"), F.lit("."), F.lit("+"), F.lit("."), name)), "gtf"))


@query("gff_gene_ids", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'T' || p_partkey::VARCHAR WHEN 1 THEN 'I' || p_partkey::VARCHAR WHEN 2 THEN 'unassigned_gene' ELSE 'own' END AS gene_id FROM part")
def _(spark, sf):
    k, s = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    attr = F.when(k == 0, F.concat(F.lit("ID=x;Parent=T"), s, F.lit(".1"))).when(k == 1, F.concat(F.lit("ID=I"), s, F.lit(".2;"))).when(k == 2, "Note=none").otherwise("ID=z;gene_id=own")
    out = readers.gff_with_gene_ids(spark, lines(spark, t(spark, sf, "part").select(tabbed(F.lit("1"), F.lit("s"), F.lit("mRNA"), s, F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attr)), "gff"))
    return out.select(F.split_part("value", F.lit("\t"), F.lit(4)).cast("long").alias("p_partkey"), F.regexp_extract("value", "gene_id=(.*)$", 1).alias("gene_id"))


@query("id_list_scan", "SELECT DISTINCT 'N' || c_nationkey::VARCHAR AS id FROM customer")
def _(spark, sf):
    return readers.id_list(spark, lines(spark, t(spark, sf, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(", ,N0")).alias("value")), "ids")).select("id")


@query("platform_annotation_scan", "SELECT p_partkey, split_part(p_name, ' ', 1) AS locus FROM part")
def _(spark, sf):
    path = fresh(spark, "gpl")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    t(spark, sf, "part").select("p_partkey", F.concat(first, F.lit(" // x /// other")).alias("Gene Symbol"), F.concat(first, F.lit(" /// b")).alias("AGI")).write.csv(path, header=True)
    df = spark.read.csv(path, header=True)
    return df.select(F.col("p_partkey").cast("long").alias("p_partkey"), readers.annotation_locus(df).alias("locus"))


@query("label_json_scan", "SELECT upper('gsm' || s_suppkey::VARCHAR) AS sample_id, axis, label, intensity FROM (SELECT s_suppkey, unnest(['tissue', 'treatment']) AS axis, unnest([s_name, 'Heat']) AS label, unnest([NULL, (s_nationkey % 4)::INT]) AS intensity FROM supplier)")
def _(spark, sf):
    doc = F.concat(F.lit('{"gsm'), F.col("s_suppkey").cast("string"), F.lit('": {"tissue": ["'), "s_name", F.lit('"], "treatment": [{"val": "Heat", "intensity": '), (F.col("s_nationkey") % 4).cast("string"), F.lit("}]}}"))
    body = t(spark, sf, "supplier").withColumn("d", doc).select((F.col("s_suppkey") % 4).alias("p"), F.expr("substring(d, 2, length(d) - 2)").alias("d"))
    path = fresh(spark, "labels")
    body.groupBy("p").agg(F.concat(F.lit("{"), F.concat_ws(",", F.collect_list("d")), F.lit("}")).alias("value")).write.partitionBy("p").text(path)
    return readers.label_documents(spark, f"{path}/p=*").select("sample_id", "axis", "label", "intensity")


@query("failing_sample_scan", "SELECT DISTINCT 'S' || user_id::VARCHAR AS sample FROM events WHERE event_type = 'error'")
def _(spark, sf):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("x Error executing process > 'ALIGN (S"), F.col("user_id").cast("string"), F.lit(")'"))).otherwise("fine")
    return readers.failing_samples(spark.read.text(lines(spark, t(spark, sf, "events").select(line.alias("value")), "log")), "value")


@query("curated_list_scan", "SELECT c_name AS accession FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 13")
def _(spark, sf):
    path = fresh(spark, "curated")
    t(spark, sf, "customer").select(F.col("c_name").alias("accession"), F.when(F.col("c_mktsegment") == "BUILDING", "GEO").otherwise("x").alias("depository_source"), F.when(F.col("c_nationkey") < 13, "Arabidopsis thaliana").otherwise("y").alias("species")).write.csv(path, header=True)
    return readers.curated(spark, path)


@query("checkpoint_scan", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    from verdure.storage import cut

    return cut(t(spark, sf, "supplier").select("s_suppkey", "s_name"))


@query("enrichment_table_scan", "SELECT p_type AS norm, p_partkey AS go_id, p_retailprice AS fdr FROM part WHERE p_type <> 'SMALL'")
def _(spark, sf):
    path = fresh(spark, "results")
    t(spark, sf, "part").where("p_type <> 'SMALL'").select(F.col("p_type").alias("norm"), F.col("p_partkey").alias("go_id"), F.col("p_retailprice").alias("fdr")).write.partitionBy("norm").parquet(path)
    return readers.results(spark, {k: f"{path}/norm={k}" for k in TYPES}, ("go_id", "fdr"), "norm")


# --- sinks ---


@query("matrix_sink", "SELECT l_returnflag AS study_id, l_partkey AS gene_id, l_suppkey AS sample_id, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, sf):
    from verdure.plans.matrix_queries import long

    path = fresh(spark, "sink")
    sinks.write_matrix(long(spark, sf), path, "study_id")
    return spark.read.parquet(path).groupBy("study_id", "gene_id", "sample_id").agg(F.count("*").alias("n"))


@query("sample_map_sink", "SELECT DISTINCT s_suppkey AS \"SampleID\", s_nationkey AS \"StudyID\" FROM supplier")
def _(spark, sf):
    path = fresh(spark, "map")
    sinks.write_sample_map(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("study_id")), path)
    return spark.read.csv(path, header=True, schema="SampleID long, StudyID long")


@query("demultiplex_sink", "SELECT s_nationkey AS study_id, l_suppkey AS sample_id, l_partkey AS gene_id, l_quantity AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0")
def _(spark, sf):
    path = fresh(spark, "demux")
    m = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value"))
    sinks.write_demultiplexed(m, t(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("study_id")), path)
    return spark.read.parquet(path).withColumn("study_id", F.col("study_id").cast("long")).select("study_id", "sample_id", "gene_id", "value")


@query("metadata_json_sink", "SELECT s_suppkey, s_name AS title, false AS has_contact FROM supplier")
def _(spark, sf):
    path = fresh(spark, "json")
    m = F.create_map(F.lit("title"), F.col("s_name"), F.lit("contact_name"), F.lit("x"), F.lit("supplementary_file"), F.lit("y"))
    sinks.write_metadata_json(t(spark, sf, "supplier").select("s_suppkey", m.alias("sample_metadata")), path)
    back = spark.read.schema("s_suppkey long, sample_metadata map<string,string>").json(path)
    return back.select("s_suppkey", F.col("sample_metadata.title").alias("title"), F.exists(F.map_keys("sample_metadata"), lambda k: k.contains("contact") | k.contains("supplementary")).alias("has_contact"))


@query("characteristics_sink", "SELECT s_suppkey AS sample_id, 'growth_stage' AS key, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'characteristic_1', 'plain' FROM supplier")
def _(spark, sf):
    return sinks.characteristics(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.array(F.concat(F.lit("Growth Stage: "), "s_name"), F.lit("plain")).alias("characteristics")))


@query("labels_csv_sink", "SELECT s_suppkey AS sample_id, s_nationkey AS study_id, CASE WHEN s_acctbal > 0 THEN 'a_' || s_name ELSE 'unspecified' END AS tissue FROM supplier")
def _(spark, sf):
    path = fresh(spark, "labels")
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("study_id"), F.when(F.col("s_acctbal") > 0, F.array("s_name", F.lit("a"))).alias("tissue"))
    s = s.withColumn("tissue", F.transform("tissue", lambda x: F.when(x == "a", "A").otherwise(x)))
    sinks.write_labels_csv(s, path, ["tissue"])
    return spark.read.csv(path, header=True, schema="sample_id long, study_id long, tissue string").withColumn("tissue", F.regexp_replace("tissue", "^A_", "a_"))


@query("status_append_sink", "SELECT user_id AS study_id, arg_max(value::INT, (ts, event_id)) AS code FROM events GROUP BY 1")
def _(spark, sf):
    from verdure.operators.tables import latest

    path = fresh(spark, "status")
    e = t(spark, sf, "events").select(F.col("user_id").alias("study_id"), F.bround("value").cast("int").alias("code"), F.struct("ts", "event_id").alias("at"), "event_type")
    for part in ("event_type IN ('view', 'click')", "event_type NOT IN ('view', 'click')"):
        sinks.append_status(e.where(part), path)
    return latest(spark.read.parquet(path), "study_id", "at").select("study_id", "code")


@query("samplesheet_sink", "SELECT c_custkey AS sample FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    bad = t(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sample"))
    return sinks.samplesheet_without(t(spark, sf, "customer").select(F.col("c_custkey").alias("sample")), bad)[0]


@query("id_list_sink", "SELECT n_name AS id, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation")
def _(spark, sf):
    path = fresh(spark, "list")
    sinks.write_id_list(t(spark, sf, "nation").coalesce(1), path, "n_name", "n_nationkey")
    return readers.id_list(spark, path).select("id", F.row_number().over(Window.orderBy("pos")).cast("long").alias("n")).select("id", (F.col("n") - 1).alias("pos"))
