"""Sinks run twice, facts of studies, lists of missing samples, and matrices whose files have different headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.operators import linear
from verdure.plans.matrix_queries import r
from verdure.plans.model_queries import cells, samples
from verdure.plans.registry import query, t
from verdure.sources import durable, readers
from verdure.storage import fresh


@query("result_written_once", "SELECT l_suppkey AS gene_id, count(*) AS n, 1 AS writes FROM lineitem GROUP BY 1")
def _(spark, sf):
    """Written, left without its marker as by a killed run, written again, and found done."""
    path = fresh(spark, "result")
    make = lambda: t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gene_id")).agg(F.count("*").alias("n"))
    durable.write_once(spark, path, make, ("n", "gene_id"))
    durable.remove(spark, f"{path}/{durable.DONE}")
    writes = [durable.write_once(spark, path, make, ("n", "gene_id")) for _ in range(3)]
    return spark.read.parquet(path).withColumn("writes", F.lit(sum(writes)))


@query("de_sorted_sink", """WITH m AS (SELECT l_suppkey AS gene_id, l_orderkey AS sample_id, avg(ln(l_extendedprice)) AS y FROM lineitem GROUP BY 1, 2),
x AS (SELECT gene_id, y, (o_orderpriority = '1-URGENT')::INT AS d FROM m JOIN orders ON o_orderkey = sample_id)
SELECT gene_id, round(avg(y) FILTER (d = 1) - avg(y) FILTER (d = 0), 7) AS log_fc FROM x GROUP BY 1""")
def _(spark, sf):
    path = fresh(spark, "de")
    make = lambda: linear.linear_fit(cells(spark, sf), samples(spark, sf), ("target",), linear.last_less_first("target")).select("gene_id", r("log_fc", 7).alias("log_fc"))
    durable.write_once(spark, path, make, (F.asc_nulls_last("log_fc"), "gene_id"), "csv")
    return spark.read.csv(path, header=True, schema="gene_id long, log_fc double")


@query("study_facts", """WITH f AS (SELECT user_id, arg_max((value::INT)::VARCHAR, (ts, value)) FILTER (event_type = 'view') AS status, arg_max('e' || (event_id % 5), (ts, 'e' || (event_id % 5))) FILTER (event_type = 'click') AS ecotype, arg_max(props->>'k', (ts, props)) FILTER (event_type = 'error') AS k FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS study_id, status, ecotype, CASE WHEN k IS NOT NULL THEN 'Unknown' END AS platform, k::INT AS num_samples FROM f WHERE status IS NOT NULL OR ecotype IS NOT NULL OR k IS NOT NULL""")
def _(spark, sf):
    path, kinds = fresh(spark, "facts"), ("status", "ecotype", "meta")
    e = t(spark, sf, "events").withColumn("study_id", F.col("user_id").cast("string"))
    says = {"view": ("status", F.bround("value").cast("int").cast("string")), "click": ("ecotype", F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string"))), "error": ("meta", F.concat(F.lit('{"num_samples": '), F.get_json_object("props", "$.k"), F.lit("}")))}
    for kind, (name, value) in says.items():
        durable.append_facts(e.where(F.col("event_type") == kind).select("study_id", F.lit(name).alias("kind"), value.alias("value"), F.col("ts").alias("at")), path)
    facts = durable.current_facts(spark, path, kinds)
    return facts.join(durable.study_report(facts), "study_id", "left").select("study_id", "status", "ecotype", "platform", "num_samples")


@query("missing_samples_scan", "SELECT 'GSE' || user_id AS study_id, string_agg('SRR' || event_id, ',' ORDER BY event_id) AS samples, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def _(spark, sf):
    path = fresh(spark, "missing")
    e = t(spark, sf, "events").where("event_type = 'error'").select(F.concat(F.lit("GSE"), F.col("user_id").cast("string")).alias("study_id"), F.concat(F.lit("SRR"), F.col("event_id").cast("string")).alias("sample"), "event_id")
    durable.write_missing_lists(e, path, "event_id")
    return durable.missing_lists(spark, path).select("study_id", F.array_join("samples", ",").alias("samples"), "n")


@query("missing_list_archived", "SELECT user_id::VARCHAR AS study_id, count(*) AS now, (SELECT count(*) FROM events b WHERE b.event_type = 'error' AND b.user_id = a.user_id) AS before FROM events a WHERE event_type = 'purchase' GROUP BY user_id")
def _(spark, sf):
    """The list of errors is replaced by that of purchases, twice over with one stamp."""
    path = fresh(spark, "lists")
    some = lambda kind: t(spark, sf, "events").where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("study_id"), F.col("event_id").cast("string").alias("sample"))
    durable.replace_list(some("error"), path, "1")
    for _ in range(2):
        durable.replace_list(some("purchase"), path, "2")
    old = spark.read.schema("study_id string, sample string").parquet(f"{path}/archive/until=2/stamp=1").groupBy("study_id").agg(F.count("*").alias("before"))
    return durable.missing_now(spark, path).select("study_id", F.col("n").alias("now")).join(old, "study_id", "left").select("study_id", "now", F.coalesce("before", F.lit(0)).alias("before"))


@query("matrix_mixed_headers_scan", """SELECT p_brand AS gene_id, p_type AS sample_id, round(sum(p_retailprice), 2) AS value FROM part WHERE p_type IN ('ECONOMY', 'LARGE', 'PROMO', 'SMALL') AND (p_size > 25) = (p_type IN ('PROMO', 'SMALL')) GROUP BY 1, 2""")
def _(spark, sf):
    """Two files, of other samples in another order, one with its gene column in the middle; read at once, and of one file one sample in two."""
    one, two = fresh(spark, "matrix"), fresh(spark, "matrix")
    p = t(spark, sf, "part")
    sums = lambda d, kinds: d.groupBy("p_brand").pivot("p_type", kinds).agg(r(F.sum("p_retailprice"), 2)).coalesce(1)
    sums(p.where("p_size <= 25"), ["LARGE", "ECONOMY", "MEDIUM"]).write.csv(one, header=True)
    sums(p.where("p_size > 25"), ["STANDARD", "SMALL", "PROMO"]).select("STANDARD", "SMALL", "p_brand", "PROMO").write.option("quoteAll", "true").csv(two, header=True)
    return readers.wide_csv(spark, [one, two], gene="p_brand", samples=("LARGE", "ECONOMY", "SMALL", "PROMO")).where("value IS NOT NULL")
