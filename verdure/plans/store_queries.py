"""Labels, label maps, batches and reviews written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.plans.registry import query, t
from verdure.sources import label_store
from verdure.storage import cut, fresh


@query("label_study_files", "SELECT DISTINCT (s_nationkey)::VARCHAR AS study_id, 'S' || s_suppkey AS id, a AS axis, l AS label FROM (SELECT s_nationkey, s_suppkey, unnest(['name', 'part', 'part']) AS a, unnest([s_name, 'p' || (s_suppkey % 3), 'p' || (s_suppkey % 2)]) AS l FROM supplier)")
def _(spark, sf):
    path = fresh(spark, "labels")
    part = lambda n: F.concat(F.lit("p"), (F.col("s_suppkey") % n).cast("string"))
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("label")) for a, c in (("name", F.col("s_name")), ("part", part(3)), ("part", part(2)))])).alias("x")
    s = t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("study_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("sample_id"), cells)
    label_store.write_labels(s.select("study_id", "sample_id", "x.axis", "x.label"), path)
    return label_store.condensed(spark, path)


@query("label_map_saved", """WITH p AS (SELECT o_custkey AS study, o_orderkey AS sample, axis, raw, label, o_orderkey AS k, o_orderstatus = 'F' AS old FROM (SELECT *, unnest(['priority', 'clerk']) AS axis, unnest([o_orderpriority, (o_custkey % 50)::VARCHAR]) AS raw, unnest([o_orderstatus || o_custkey % 7, o_orderpriority]) AS label FROM orders)),
f AS (SELECT axis, raw, coalesce(arg_min(label, (k, label)) FILTER (old), arg_min(label, (k, label))) AS label, count(DISTINCT study) AS studies, count(*) AS samples FROM p GROUP BY 1, 2) SELECT * FROM f""")
def _(spark, sf):
    """A map of the 'F' orders is saved, loaded, and all orders are added to it and saved again: what it said first stays."""
    one, two, axes = fresh(spark, "map"), fresh(spark, "map"), ("priority", "clerk")
    o = t(spark, sf, "orders")
    kinds = {"priority": (F.col("o_orderpriority"), F.concat("o_orderstatus", (F.col("o_custkey") % 7).cast("string"))), "clerk": ((F.col("o_custkey") % 50).cast("string"), F.col("o_orderpriority"))}
    side = lambda k: F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), c[k].alias("label")) for a, c in kinds.items()])).alias("x")
    long = lambda k: o.select(F.col("o_custkey").cast("string").alias("study_id"), F.col("o_orderkey").cast("string").alias("sample_id"), side(k)).select("study_id", "sample_id", "x.*")
    pairs = cut(label_store.single_pairs(long(0), long(1)).withColumn("at", F.col("sample_id").cast("long")), "pairs")
    early = pairs.join(o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("at")), "at", "left_semi")
    label_store.save_map(*label_store.add_pairs(*label_store.load_map(spark, one), early, axes), one)
    label_store.save_map(*label_store.add_pairs(*label_store.load_map(spark, one), pairs, axes), two)
    labels, seen = label_store.load_map(spark, two)
    met = seen.groupBy("axis", "raw").agg(F.count_distinct("study_id").alias("studies"), F.count("*").alias("samples"))
    return labels.join(met, ["axis", "raw"]).select("axis", "raw", "label", "studies", "samples")


@query("batch_demultiplexed", """WITH m AS (SELECT DISTINCT l_suppkey AS s FROM lineitem), x AS (SELECT s, s_nationkey::VARCHAR AS study_id FROM m JOIN supplier ON s_suppkey = s)
SELECT study_id, 'S' || s AS sample, CASE s % 4 WHEN 0 THEN 'unspecified' WHEN 1 THEN 'unspecified' ELSE (s * 10)::VARCHAR END AS processed, CASE s % 4 WHEN 3 THEN '50.5' ELSE 'unspecified' END AS percent, n AS genes FROM x JOIN (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) USING (s)""")
def _(spark, sf):
    path = fresh(spark, "batch")
    name = lambda c: F.concat(F.lit("S"), F.col(c).cast("string"))
    counts = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene_id"), name("l_suppkey").alias("sample_id")).agg(F.sum("l_quantity").alias("value"))
    s = t(spark, sf, "supplier").select("s_suppkey", name("s_suppkey").alias("sample_id"), F.col("s_nationkey").cast("string").alias("study_id"))
    k, reads = F.col("s_suppkey") % 4, (F.col("s_suppkey") * 10).cast("string")
    report = F.when(k == 1, "{broken").when(k == 2, F.concat(F.lit('{"num_processed": '), reads, F.lit("}"))).when(k == 3, F.concat(F.lit('{"num_processed": '), reads, F.lit(', "percent_mapped": 50.5}')))
    label_store.write_batch(counts, None, s, s.select("sample_id", report.alias("json")).where("json IS NOT NULL"), path, "b1", "results/b1", "2024-01-01T00:00:00Z")
    coverage = spark.read.csv(f"{path}/coverage", header=True).select(F.col("study_id").cast("string").alias("study_id"), F.col("Sample").alias("sample"), F.col("Total_Reads_Processed").alias("processed"), F.col("Percent_Mapped").alias("percent"))
    genes = spark.read.parquet(f"{path}/counts").groupBy(F.col("study_id").cast("string").alias("study_id"), F.col("sample_id").alias("sample")).agg(F.count("*").alias("genes"))
    return coverage.join(genes, ["study_id", "sample"])


@query("review_results_scan", "SELECT o_custkey::VARCHAR AS study_id, 'unknown_legacy_user' AS username, count(*) AS n, count(DISTINCT o_orderpriority) AS comments FROM orders GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "reviews")
    t(spark, sf, "orders").select(F.col("o_custkey").alias("study_id"), F.col("o_orderkey").alias("sample_id"), F.lit('{"tissue": 1, "x": "a, b"}').alias("label_scores"), F.col("o_orderpriority").alias("comments")).write.option("escape", '"').csv(path, header=True)
    return label_store.reviews(spark, path).groupBy("study_id", "username").agg(F.count("*").alias("n"), F.count_distinct("comments").alias("comments"))
