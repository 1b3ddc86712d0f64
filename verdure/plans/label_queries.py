"""Queries of labels, eligibility and comparison of labellings, each by its operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.operators import labels, matrix
from verdure.plans.matrix_queries import LONG, long, r
from verdure.plans.registry import query, t


def part_labels(spark, sf):
    p = t(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sample_id"), F.explode(F.expr("array(struct('tissue' AS axis, p_type AS label), struct('treatment' AS axis, p_brand AS label), struct('tissue' AS axis, split_part(p_name, ' ', 1) AS label))")).alias("x"))
    return p.select("sample_id", "x.axis", "x.label").where("NOT (axis = 'treatment' AND label LIKE '%1')")


@query("study_of_column", "WITH c AS (SELECT 'S' || c_custkey::VARCHAR || '_x.1' AS \"column\", c_custkey, c_nationkey FROM customer) SELECT \"column\", CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_nationkey::VARCHAR ELSE 'S' || c_custkey::VARCHAR END AS study_id FROM c")
def _(spark, sf):
    c = t(spark, sf, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string"), F.lit("_x")).alias("sample_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("study_id"), "c_custkey")
    return labels.study_of(c.select(F.concat("sample_id", F.lit(".1")).alias("column")), c.where("c_custkey % 3 = 0").select("sample_id", "study_id")).select("column", "study_id")


@query("covariate_frame", "SELECT 'S' || p_partkey::VARCHAR AS sample_id, array_to_string(list_sort(list_distinct([p_type, split_part(p_name, ' ', 1)])), '_') AS tissue, CASE WHEN p_brand LIKE '%1' THEN 'unknown' ELSE p_brand END AS treatment FROM part")
def _(spark, sf):
    return labels.covariates(t(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sample_id")), part_labels(spark, sf), ("tissue", "treatment"))


@query("rank_class_labels", "SELECT 's' || p_partkey::VARCHAR AS sample_id, (CASE WHEN p_brand LIKE '%1' THEN 'Unspecified' ELSE p_brand END) || '_' || array_to_string(list_sort(list_distinct([p_type, split_part(p_name, ' ', 1)])), '-') AS class FROM part")
def _(spark, sf):
    return labels.class_labels(part_labels(spark, sf))


@query("substring_join", "SELECT p_partkey, (SELECT min(w) FROM (VALUES ('red'), ('blue'), ('spring'), ('ring')) v(w) WHERE contains(p_name, w)) AS word FROM part")
def _(spark, sf):
    names = spark.createDataFrame([("red",), ("blue",), ("spring",), ("ring",)], "w string")
    return labels.contains(t(spark, sf, "part"), names, F.col("p_name"), "w", "word").select("p_partkey", "word")


@query("unmatched_samples", "WITH s AS (SELECT n_name AS sample_id FROM nation), k AS (SELECT DISTINCT upper(substr(n_name, 1, 8)) AS k FROM nation WHERE n_nationkey % 2 = 0) SELECT sample_id, (SELECT min(k) FROM k WHERE contains(upper(sample_id), k) OR contains(k, upper(sample_id))) AS near FROM s WHERE upper(sample_id) NOT IN (SELECT k FROM k)")
def _(spark, sf):
    n = t(spark, sf, "nation")
    return labels.unmatched(n.select(F.col("n_name").alias("sample_id")), n.where("n_nationkey % 2 = 0").select(F.substring("n_name", 1, 8).alias("sample_id")))


@query("tissue_scope", "SELECT p_partkey, contains(p_name, 'r') AS scoped, p_name IS NOT NULL AS every FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", labels.in_scope(F.col("p_name"), "r").alias("scoped"), labels.in_scope(F.col("p_name"), None).alias("every"))


@query("singleton_classes", "SELECT o_orderkey FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2")
def _(spark, sf):
    return labels.without_singletons(t(spark, sf, "orders"), "o_custkey").select("o_orderkey")


@query("incompatible_runs", "WITH b AS (SELECT user_id AS study_id, event_id AS run, CASE WHEN event_type = 'click' THEN 'instrument' ELSE 'strategy' END AS reason FROM events WHERE event_type IN ('click', 'error')) SELECT study_id, min(run) AS run, arg_min(reason, run) AS reason FROM b GROUP BY 1")
def _(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("study_id"), F.col("event_id").alias("run"), F.when(F.col("event_type") == "click", "AB SOLiD 4").otherwise("Illumina").alias("instrument"), F.when(F.col("event_type") == "error", "CAGE").otherwise("RNA-Seq").alias("strategy"))
    return labels.incompatible(e)


@query("eligible_studies", "SELECT o_custkey AS study_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT o_orderstatus = 'P') = 1 AND bool_or(o_totalprice > 200000)")
def _(spark, sf):
    return labels.eligible(t(spark, sf, "orders").select(F.col("o_custkey").alias("study_id"), (F.col("o_orderstatus") == "P").alias("kind"), (F.col("o_totalprice") > 200000).alias("has_raw")))


@query("run_cache_clean", "WITH c AS (SELECT o_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'GSM' ELSE 'SRR' END || o_orderkey::VARCHAR AS v FROM orders) SELECT key, count(*) AS n FROM c WHERE v LIKE 'SRR%' GROUP BY 1")
def _(spark, sf):
    v = F.concat(F.when(F.col("o_orderstatus") == "F", "GSM").otherwise("SRR"), F.col("o_orderkey").cast("string"))
    c = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(v).alias("values"))
    return labels.cleaned_cache(c).select("key", F.size("values").cast("long").alias("n"))


@query("label_matrix_match", "WITH l AS (SELECT o_custkey AS k, o_orderkey, o_orderpriority AS label FROM orders), m AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT k, label FROM l WHERE k IN (SELECT k FROM m) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderkey) = 1")
def _(spark, sf):
    return labels.matched(t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderpriority").alias("label")), t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k", "o_orderkey")[0].select("k", "label")


@query("label_mismatch_report", "WITH l AS (SELECT DISTINCT o_custkey AS k FROM orders), m AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT k, 'label only' AS side FROM l WHERE k NOT IN (SELECT k FROM m) UNION ALL SELECT k, 'matrix only' FROM m WHERE k NOT IN (SELECT k FROM l)")
def _(spark, sf):
    return labels.matched(t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey"), t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k", "o_orderkey")[1]


@query("gene_set_build", "SELECT p_size::VARCHAR || ' (term ' || p_size::VARCHAR || ')' AS \"set\", array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS genes FROM part WHERE p_size > 10 GROUP BY p_size")
def _(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_brand").alias("gene_id"), F.col("p_size").alias("go_id"))
    names = p.where("go_id > 10").select("go_id").distinct().withColumn("name", F.concat(F.lit("term "), F.col("go_id").cast("string")))
    return labels.gene_sets(p, names).select("set", F.array_join("genes", ",").alias("genes"))


@query("gene_union_size", "SELECT p_brand AS root, count(DISTINCT w) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def _(spark, sf):
    return labels.union_size(t(spark, sf, "part").select(F.col("p_brand").alias("root"), F.regexp_replace("p_name", " ", ";").alias("genes")), "root", "genes")


@query("hits_per_method", "SELECT p_type AS norm, count_if(p_size > 25) AS hits, count(*) AS n, round(count_if(p_size > 25) / count(*), 9) AS share FROM part GROUP BY 1")
def _(spark, sf):
    return labels.hits_per_method(t(spark, sf, "part").select(F.col("p_type").alias("norm"), (F.col("p_size") > 25).alias("hit")), "norm", "hit").withColumn("share", r("share", 9))


@query("canonical_labels", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_type || '|' || upper(p_name) || '|' || p_type, '|'), lambda x: lower(trim(x))))), '|') AS form FROM part")
def _(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.array_join(labels.canonical(F.array("p_type", F.upper("p_name"), F.concat(F.lit(" "), "p_type"))), "|").alias("form"))


@query("treatment_changes", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'same' WHEN o_orderkey % 4 = 1 THEN 'intensity_only' WHEN o_orderkey % 4 = 2 THEN 'val_only' ELSE 'both_changed' END AS kind, CASE WHEN o_orderstatus < 'Heat' THEN o_orderstatus || '+Heat [i=' || (o_orderkey % 3)::VARCHAR || ',1]' ELSE 'Heat+' || o_orderstatus || ' [i=1,' || (o_orderkey % 3)::VARCHAR || ']' END AS said FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    one = lambda val, i: F.struct(val.alias("val"), i.cast("int").alias("intensity"))
    a = F.array(one(F.lit("Heat"), F.lit(1)), one(F.col("o_orderstatus"), F.col("o_orderkey") % 3))
    b = F.array(one(F.when(k >= 2, "Cold").otherwise("heat"), F.when(k % 2 == 1, 9).otherwise(1)), one(F.col("o_orderstatus"), F.col("o_orderkey") % 3))
    return t(spark, sf, "orders").select("o_orderkey", labels.change_of(a, b).alias("kind"), labels.readable(a).alias("said"))


@query("exclusive_states", "SELECT user_id AS study_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def _(spark, sf):
    return labels.exclusive_state(t(spark, sf, "events").select(F.col("user_id").alias("study_id"), F.col("event_type").alias("state"), "ts", "event_id"), "study_id", "state", "ts", "event_id")


@query("ordered_categories", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return labels.sorted_by(t(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", ["5-LOW", "1-URGENT"])


@query("rna_normalise", f"WITH {LONG}, d AS (SELECT gene_id, sample_id, avg(value) AS value FROM m GROUP BY 1, 2), g AS (SELECT gene_id FROM d, (SELECT count(DISTINCT sample_id) AS k FROM d) GROUP BY 1 HAVING 100 * (1 - count(DISTINCT sample_id) / any_value(k)) <= 75), f AS (SELECT * FROM d WHERE gene_id IN (SELECT gene_id FROM g)), s AS (SELECT sample_id FROM f, (SELECT count(DISTINCT gene_id) AS n FROM f) GROUP BY 1 HAVING 100 * (1 - count(DISTINCT gene_id) / any_value(n)) <= 74) SELECT gene_id, sample_id, round(log2(value + 1), 6) AS value FROM f WHERE sample_id IN (SELECT sample_id FROM s)")
def _(spark, sf):
    return matrix.normalise_counts(matrix.combine_duplicates(long(spark, sf)), 75, 74)[1].withColumn("value", r("value"))
