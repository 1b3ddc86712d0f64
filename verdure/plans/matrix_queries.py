"""Matrix, rank and window queries; lineitem is a sparse matrix (part, supplier, price), embeddings a dense one."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.operators import matrix, ranks
from verdure.plans.registry import query, t

LONG = "m AS (SELECT l_partkey AS gene_id, l_suppkey AS sample_id, l_extendedprice AS value, l_returnflag AS study_id FROM lineitem)"
DENSE = "e AS (SELECT vec_id AS sample_id, label AS class, generate_subscripts(embedding, 1) - 1 AS gene_id, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def long(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.col("l_suppkey").alias("sample_id"), F.col("l_extendedprice").alias("value"), F.col("l_returnflag").alias("study_id"))


def dense(spark, sf):
    return t(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("class"), F.posexplode("embedding").alias("gene_id", "v")).select("sample_id", "class", "gene_id", F.col("v").cast("double").alias("value"))


def r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def near(c, n=6):
    """c rounded by a product, half away from 0, as the SQL's engine does it; for very many rows, as round() goes through decimals."""
    c = F.col(c)
    return F.signum(c) * F.floor(F.abs(c) * 10.0**n + 0.5) / 10.0**n


@query("rankin_class_center", f"""WITH {DENSE},
p AS (SELECT *, ceil((rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY sample_id) * 100)::BIGINT AS r FROM e),
s AS (SELECT sample_id, count(*)::DOUBLE n, sum(r::DOUBLE) s1, sum(r::DOUBLE**2) s2, sum(r::DOUBLE**3) s3, sum(r::DOUBLE**4) s4, sum(value) t0, sum(r*value) t1, sum(r::DOUBLE**2*value) t2 FROM p GROUP BY 1),
f AS (SELECT sample_id, (t2*(s2*n-s1*s1) - s3*(t1*n-s1*t0) + s2*(t1*s1-s2*t0)) / (s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2)) AS a,
  (s4*(t1*n-t0*s1) - t2*(s3*n-s1*s2) + s2*(s3*t0-t1*s2)) / (s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2)) AS b FROM s),
w AS (SELECT p.*, r * (2*a*r + b) AS weighted FROM p JOIN f USING (sample_id))
SELECT gene_id, sample_id, r, round(weighted, 5) AS weighted, round(weighted - avg(weighted) OVER (PARTITION BY gene_id, class), 5) AS centered FROM w""")
def _(spark, sf):
    w = ranks.center(ranks.weighted_ranks(dense(spark, sf)), ("gene_id", "class"), "weighted")
    return w.select("gene_id", "sample_id", "r", r("weighted", 5).alias("weighted"), r("centered", 5).alias("centered"))


@query("matrix_long_scan", f"WITH {DENSE} SELECT gene_id, sample_id, value FROM e")
def _(spark, sf):
    return dense(spark, sf).select("gene_id", "sample_id", "value")


@query("gene_missing_filter", f"""WITH {LONG}, n AS (SELECT count(DISTINCT sample_id) AS k FROM m),
g AS (SELECT gene_id, 100 * (1 - count(DISTINCT CASE WHEN value <> 0 THEN sample_id END) / any_value(k)) AS pct FROM m, n GROUP BY 1)
SELECT gene_id, sample_id, value FROM m WHERE gene_id IN (SELECT gene_id FROM g WHERE pct <= 75)""")
def _(spark, sf):
    return matrix.filter_missing(long(spark, sf), most_pct=75).select("gene_id", "sample_id", "value")


@query("sample_missing_filter", f"""WITH {LONG}, n AS (SELECT count(DISTINCT sample_id) AS k FROM m),
g AS (SELECT gene_id FROM m, n GROUP BY 1 HAVING 100 * (1 - count(DISTINCT CASE WHEN value <> 0 THEN sample_id END) / any_value(k)) <= 75),
f AS (SELECT * FROM m WHERE gene_id IN (SELECT gene_id FROM g)), k AS (SELECT count(DISTINCT gene_id) AS n FROM f)
SELECT sample_id, round(100 * (1 - count(DISTINCT CASE WHEN value <> 0 THEN gene_id END) / any_value(n)), 6) AS missing_pct FROM f, k GROUP BY 1""")
def _(spark, sf):
    kept = matrix.filter_missing(long(spark, sf), most_pct=75)
    return matrix.missing_share(kept, "sample_id", "gene_id").select("sample_id", r("missing_pct").alias("missing_pct"))


@query("noise_gene_filter", f"WITH {LONG} SELECT gene_id, count(*) AS n FROM m GROUP BY 1 HAVING count(DISTINCT CASE WHEN value > 60000 THEN sample_id END) >= 3")
def _(spark, sf):
    return matrix.noise_filter(long(spark, sf), 60000, 3).groupBy("gene_id").agg(F.count("*").alias("n"))


@query("range_guard_stats", f"WITH {LONG} SELECT study_id, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean, max(value) > 100000 AS out_of_range FROM m GROUP BY 1")
def _(spark, sf):
    return long(spark, sf).groupBy("study_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), r(F.avg("value"), 4).alias("mean"), (F.max("value") > 100000).alias("out_of_range"))


@query("range_guard", f"WITH {LONG} SELECT study_id, count(*) AS n, round(max(log2(value + 1)), 6) AS high FROM m GROUP BY 1")
def _(spark, sf):
    return matrix.guard_range(matrix.log2_1p(long(spark, sf)), 20).groupBy("study_id").agg(F.count("*").alias("n"), r(F.max("value")).alias("high"))


@query("duplicate_gene_mean", f"WITH {LONG} SELECT gene_id, sample_id, round(avg(value), 4) AS value FROM m GROUP BY 1, 2")
def _(spark, sf):
    return matrix.combine_duplicates(long(spark, sf)).withColumn("value", r("value", 4))


for how in ("max", "sum"):

    @query(f"isoform_combine_{how}", f"WITH {LONG} SELECT split_part((gene_id // 4)::VARCHAR || '.' || (gene_id % 4)::VARCHAR, '.', 1) AS gene_id, sample_id, round({how}(value), 2) AS value FROM m GROUP BY 1, 2")
    def _(spark, sf, how=how):
        iso = long(spark, sf).withColumn("gene_id", F.concat_ws(".", F.expr("gene_id div 4").cast("string"), (F.col("gene_id") % 4).cast("string")))
        return matrix.combine_duplicates(iso.withColumn("gene_id", matrix.without_isoform()), how).withColumn("value", r("value", 2))


@query("batch_size_filter", "WITH s AS (SELECT s_nationkey AS study_id, count(*) AS n FROM supplier GROUP BY 1) SELECT study_id, count(*) AS cells, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN s ON s_nationkey = study_id WHERE n >= 4 GROUP BY 1")
def _(spark, sf):
    m = long(spark, sf).drop("study_id").join(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.col("s_nationkey").alias("study_id")), "sample_id")
    return matrix.drop_small_batches(m, "study_id", 4).groupBy("study_id").agg(F.count("*").alias("cells"), r(F.sum("value"), 2).alias("total"))


@query("batch_sizes", "SELECT s_nationkey AS study_id, count(*) AS n FROM supplier GROUP BY 1")
def _(spark, sf):
    return t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("study_id")).agg(F.count("*").alias("n"))


@query("log2_normalize", f"WITH {LONG}, d AS (SELECT gene_id, sample_id, avg(value) AS value FROM m GROUP BY 1, 2) SELECT gene_id, sample_id, round(log2(value + 1), 6) AS value FROM d")
def _(spark, sf):
    _, norm = matrix.normalise_counts(matrix.combine_duplicates(long(spark, sf)), 100, 100)
    return norm.withColumn("value", r("value"))


@query("log1p_scale", "SELECT event_id, round(ln(value + 1), 6) AS value FROM events WHERE value >= 0")
def _(spark, sf):
    return t(spark, sf, "events").where("value >= 0").select("event_id", r(F.log1p("value")).alias("value"))


@query("library_size", f"WITH {LONG} SELECT sample_id, round(sum(value) / 1e6, 6) AS millions FROM m GROUP BY 1")
def _(spark, sf):
    return long(spark, sf).groupBy("sample_id").agg(r(F.sum("value") / 1e6).alias("millions"))


@query("gene_mean_std", f"WITH {DENSE} SELECT gene_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM e GROUP BY 1")
def _(spark, sf):
    return dense(spark, sf).groupBy("gene_id").agg(r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"))


@query("sparsity_profile", f"WITH {LONG}, c AS (SELECT sample_id, count(DISTINCT gene_id) AS n FROM m GROUP BY 1) SELECT sample_id, n, round(100 * (1 - n / (SELECT count(DISTINCT gene_id) FROM m)), 6) AS sparsity FROM c")
def _(spark, sf):
    m = long(spark, sf)
    c = m.groupBy("sample_id").agg(F.countDistinct("gene_id").alias("n"))
    return matrix.with_scalar(c, m.agg(F.countDistinct("gene_id").alias("k"))).select("sample_id", "n", r(100 * (1 - F.col("n") / F.col("k"))).alias("sparsity"))


@query("intensity_histogram", f"WITH {LONG}, x AS (SELECT max(value) AS top FROM m) SELECT study_id, least(floor(value / (top / 300)), 299)::INT AS bin, count(*) AS n FROM m, x GROUP BY 1, 2")
def _(spark, sf):
    return matrix.histogram(long(spark, sf), 300, ("study_id",))


@query("matrix_full_outer_fusion", f"""WITH {LONG}, a AS (SELECT gene_id, avg(value) AS v FROM m WHERE study_id = 'A' GROUP BY 1), n AS (SELECT gene_id, avg(value) AS v FROM m WHERE study_id = 'N' AND gene_id % 2 = 0 GROUP BY 1), q AS (SELECT gene_id, avg(value) AS v FROM m WHERE study_id = 'R' AND gene_id % 3 = 0 GROUP BY 1)
SELECT gene_id, round(a.v, 8) AS A, round(n.v, 8) AS N, round(q.v, 8) AS R FROM a FULL JOIN n USING (gene_id) FULL JOIN q USING (gene_id)""")
def _(spark, sf):
    m = long(spark, sf)
    wide = matrix.fuse_wide({"A": m.where("study_id = 'A'"), "N": m.where("study_id = 'N' AND gene_id % 2 = 0"), "R": m.where("study_id = 'R' AND gene_id % 3 = 0")})
    return wide.select("gene_id", *(r(c, 8).alias(c) for c in "ANR"))


@query("matrix_long_fusion", f"WITH {LONG} SELECT study_id, gene_id, sample_id, round(avg(value), 4) AS value FROM m GROUP BY 1, 2, 3")
def _(spark, sf):
    m = long(spark, sf)
    return matrix.fuse({k: m.where(F.col("study_id") == k) for k in "ANR"}).withColumn("value", r("value", 4))


@query("common_gene_intersection", "SELECT l_partkey AS gene_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)")
def _(spark, sf):
    m = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene_id"), F.concat("l_returnflag", "l_linestatus").alias("part"))
    return matrix.common_genes(m, "part")


@query("study_max_log_transform", """WITH f AS (SELECT l_suppkey AS sample_id, any_value(s_nationkey) AS study_id, list(l_quantity * l_linenumber ORDER BY l_orderkey, l_linenumber, l_quantity) AS data FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
g AS (SELECT *, max(list_max(data)) OVER (PARTITION BY study_id) AS top FROM f)
SELECT sample_id, study_id, round(list_sum(CASE WHEN top > 349 THEN list_transform(data, lambda x: log2(x + 1)) ELSE data END), 4) AS total FROM g""")
def _(spark, sf):
    f = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_suppkey").alias("sample_id")).agg(F.first("s_nationkey").alias("study_id"), F.collect_list(F.col("l_quantity") * F.col("l_linenumber")).alias("data"))
    return matrix.study_max_log(f, 349).select("sample_id", "study_id", r(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("sample_vectors", f"WITH {DENSE} SELECT sample_id, list(value ORDER BY gene_id)[1:3]::VARCHAR IS NOT NULL AS there, round(list_sum(list_transform(list_zip(list(value ORDER BY gene_id), range(count(*))), lambda z: z[1] * (z[2] + 1))), 5) AS head FROM e GROUP BY 1")
def _(spark, sf):
    v = matrix.to_vectors(dense(spark, sf))
    return v.select("sample_id", F.col("values").isNotNull().alias("there"), r(F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5).alias("head"))


# --- windows ---


@query("pct_rank_average", "SELECT event_id, round((rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0) / count(value) OVER (PARTITION BY user_id), 9) AS pct FROM events WHERE value IS NOT NULL")
def _(spark, sf):
    return ranks.percent_rank_average(t(spark, sf, "events").where("value IS NOT NULL"), by=("user_id",)).select("event_id", r("pct", 9).alias("pct"))


@query("rank_bins", f"WITH {DENSE} SELECT gene_id, sample_id, ceil((rank() OVER (PARTITION BY sample_id ORDER BY value) + (count(*) OVER (PARTITION BY sample_id, value) - 1) / 2.0) / count(*) OVER (PARTITION BY sample_id) * 50)::BIGINT AS bin FROM e")
def _(spark, sf):
    return ranks.rank_bins(dense(spark, sf), 50).select("gene_id", "sample_id", "bin")


@query("term_rank_percentile", """WITH p AS (SELECT p_type AS norm, p_partkey AS go_id, p_retailprice / 10000 AS fdr FROM part)
SELECT norm, go_id, row_number() OVER w AS term_rank, count(*) OVER (PARTITION BY norm) AS n_terms, round(CASE WHEN count(*) OVER (PARTITION BY norm) <= 1 THEN 0 ELSE (row_number() OVER w - 1) / (count(*) OVER (PARTITION BY norm) - 1) * 100 END, 6) AS percentile FROM p WINDOW w AS (PARTITION BY norm ORDER BY fdr, go_id)""")
def _(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_type").alias("norm"), F.col("p_partkey").alias("go_id"), (F.col("p_retailprice") / 10000).alias("fdr"))
    return ranks.rank_percentile(p, ("norm",), "fdr", "go_id").select("norm", "go_id", "term_rank", "n_terms", r("percentile").alias("percentile"))


@query("best_rank_per_gene", "SELECT l_partkey AS gene_id, l_orderkey, l_linenumber, l_extendedprice AS best FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) = 1")
def _(spark, sf):
    return ranks.first_per(t(spark, sf, "lineitem"), ("l_partkey",), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").select(F.col("l_partkey").alias("gene_id"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("best"))


@query("first_occurrence_dedup", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def _(spark, sf):
    return ranks.first_per(t(spark, sf, "events"), ("user_id", "event_type"), "ts", "event_id").select("user_id", "event_type", "event_id")


@query("cum_variance_threshold", f"""WITH {DENSE}, v AS (SELECT class, gene_id, var_samp(value) AS v FROM e GROUP BY 1, 2),
c AS (SELECT class, row_number() OVER w AS n, sum(v) OVER (PARTITION BY class ORDER BY v DESC, gene_id ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY class) AS share FROM v WINDOW w AS (PARTITION BY class ORDER BY v DESC, gene_id))
SELECT class, min(n) AS n_needed FROM c WHERE share >= 0.9 GROUP BY 1""")
def _(spark, sf):
    v = dense(spark, sf).groupBy("class", "gene_id").agg(F.var_samp("value").alias("v"))
    return ranks.first_over(v, "v", 0.9, ("class",), F.desc("v"), "gene_id")


@query("adjacent_ratio_argmax", """WITH v AS (SELECT s_nationkey AS study_id, s_suppkey, s_acctbal + 2000 AS s FROM supplier),
w AS (SELECT study_id, row_number() OVER o AS n, s / nullif(lead(s) OVER o, 0) AS q FROM v WINDOW o AS (PARTITION BY study_id ORDER BY s DESC, s_suppkey))
SELECT study_id, n AS k FROM w WHERE q IS NOT NULL QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY q DESC, n) = 1""")
def _(spark, sf):
    v = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("study_id"), "s_suppkey", (F.col("s_acctbal") + 2000).alias("s"))
    return ranks.ratio_argmax(v, "s", ("study_id",), F.desc("s"), "s_suppkey")


@query("stratified_take", "SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def _(spark, sf):
    return ranks.take_per(t(spark, sf, "orders"), ("o_orderstatus", "o_orderpriority"), 3, F.desc("o_totalprice"), "o_orderkey").select("o_orderstatus", "o_orderpriority", "o_orderkey")


@query("balanced_control_take", """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS c FROM orders), s AS (SELECT *, count_if(c) OVER (PARTITION BY o_custkey) AS nc, count_if(NOT c) OVER (PARTITION BY o_custkey) AS nn, row_number() OVER (PARTITION BY o_custkey, c ORDER BY o_orderkey) AS n FROM o)
SELECT o_custkey, o_orderkey FROM s WHERE n <= CASE WHEN c THEN least(nc, greatest(3, 6 - nn)) ELSE least(nn, 6 - least(nc, greatest(3, 6 - nn))) END""")
def _(spark, sf):
    return ranks.balanced_take(t(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", 6, "o_orderkey").select("o_custkey", "o_orderkey")


@query("chunk_ids", "SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 25)::BIGINT AS chunk FROM events")
def _(spark, sf):
    return ranks.chunks(t(spark, sf, "events"), 25, ("user_id",), "ts", "event_id").select("user_id", "event_id", "chunk")


@query("interval_union_length", """WITH i AS (SELECT l_partkey AS gene_id, l_orderkey % 500 AS s, l_orderkey % 500 + l_quantity::BIGINT AS e FROM lineitem),
g AS (SELECT *, max(e) OVER (PARTITION BY gene_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i)
SELECT gene_id, sum(greatest(0, e - greatest(s, coalesce(b, s))))::BIGINT AS length FROM g GROUP BY 1""")
def _(spark, sf):
    i = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene_id"), (F.col("l_orderkey") % 500).alias("start"), (F.col("l_orderkey") % 500 + F.col("l_quantity").cast("long")).alias("end"))
    return ranks.union_length(i, "gene_id")


@query("topk_studies", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 15")
def _(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey").agg(r(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"), "l_suppkey").limit(15)


@query("hash_sample_columns")
def _(spark, sf):
    return ranks.hash_sample(t(spark, sf, "supplier"), 20, "s_suppkey").select("s_suppkey")
