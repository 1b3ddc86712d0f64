"""Linear models and set enrichment; orders are samples, suppliers genes, parts a ranked list with its brands, kinds and sizes as sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdure.operators import gsea, linear
from verdure.plans.matrix_queries import r
from verdure.plans.registry import query, t


def cells(spark, sf):
    return t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gene_id"), F.col("l_orderkey").alias("sample_id")).agg(F.avg(F.log("l_extendedprice")).alias("value"))


def samples(spark, sf):
    target = F.when(F.col("o_orderpriority") == "1-URGENT", "treatment").otherwise("Control")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), target.alias("target"), F.col("o_orderstatus").alias("tissue"))


# One factor of two levels beside another of any number: what is left of both after the other's means.
@query("de_linear_model", """WITH m AS (SELECT l_suppkey AS gene_id, l_orderkey AS sample_id, avg(ln(l_extendedprice)) AS y FROM lineitem GROUP BY 1, 2),
x AS (SELECT gene_id, y - avg(y) OVER w AS y, d - avg(d) OVER w AS d, tissue FROM m JOIN (SELECT o_orderkey AS sample_id, (o_orderpriority = '1-URGENT')::INT AS d, o_orderstatus AS tissue FROM orders) USING (sample_id) WINDOW w AS (PARTITION BY gene_id, tissue)),
f AS (SELECT gene_id, sum(d * y) / nullif(sum(d * d), 0) AS b, nullif(sum(d * d), 0) AS ssd, count(*) - count(DISTINCT tissue) - (sum(d * d) > 0)::INT AS df FROM x GROUP BY 1)
SELECT gene_id, round(any_value(b), 7) AS log_fc, round(sum((y - coalesce(b, 0) * d)**2) / any_value(nullif(df, 0)), 7) AS s2, any_value(df)::DOUBLE AS df, round(any_value(1 / sqrt(ssd)), 7) AS scale FROM x JOIN f USING (gene_id) GROUP BY 1""")
def _(spark, sf):
    f = linear.linear_fit(cells(spark, sf), samples(spark, sf), ("target", "tissue"), linear.last_less_first("target"))
    return f.select("gene_id", r("log_fc", 7).alias("log_fc"), r("s2", 7).alias("s2"), "df", r("scale", 7).alias("scale"))


@query("de_differential")
def _(spark, sf):
    d = linear.differential(cells(spark, sf), samples(spark, sf))
    return d.select("gene_id", r("t").alias("t"), r("log_fc", 8).alias("log_fc"), r("p", 9).alias("p"), r("adj_p", 9).alias("adj_p"))


def ranking(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), (F.col("p_retailprice") - 1000 + F.col("p_partkey") / 1e6).alias("score"))


def sets(spark, sf):
    names = F.explode(F.array("p_brand", "p_type", F.concat(F.lit("SIZE "), F.floor(F.col("p_size") / 10).cast("string")), F.when(F.col("p_size") > 25, "LARGE ones").otherwise("SMALL ones")))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), names.alias("term"))


@query("gsea_limited_es", """WITH p AS (SELECT p_partkey, unnest([p_brand, p_type, 'SIZE ' || (p_size // 10), CASE WHEN p_size > 25 THEN 'LARGE ones' ELSE 'SMALL ones' END]) AS term, abs(p_retailprice - 1000 + p_partkey / 1e6) AS w, row_number() OVER (ORDER BY p_retailprice - 1000 + p_partkey / 1e6 DESC) - 1 AS i FROM part),
s AS (SELECT *, count(*) OVER (PARTITION BY term) AS k, sum(w) OVER (PARTITION BY term ORDER BY i ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY term) AS tot, row_number() OVER (PARTITION BY term ORDER BY i) - 1 AS j FROM p),
d AS (SELECT term, i, k, c / tot - (i - j) / ((SELECT count(*) FROM part) - k) AS hi, (c - w) / tot - (i - j) / ((SELECT count(*) FROM part) - k) AS lo FROM s WHERE k BETWEEN 70 AND 782),
e AS (SELECT term, any_value(k) AS n_hits, max(hi) AS hi, min(lo) AS lo, arg_max(i, hi) AS pi, arg_min(i, lo) AS qi FROM d GROUP BY 1)
SELECT term, n_hits, round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 8) AS es, (SELECT count(*) FROM d WHERE d.term = e.term AND CASE WHEN e.hi >= -e.lo THEN d.i <= e.pi ELSE d.i >= e.qi END) AS n_leading FROM e""")
def _(spark, sf):
    ranked = gsea.ranked_list(ranking(spark, sf))
    e = gsea.enrichment_scores(gsea.hits(ranked, sets(spark, sf)), ranked.count())
    return e.select("term", "n_hits", r("es", 8).alias("es"), F.size("leading_edge").cast("long").alias("n_leading"))


@query("gsea_full")
def _(spark, sf):
    g = gsea.prerank(ranking(spark, sf), sets(spark, sf))
    return g.select("term", "go_id", "n_hits", *[r(c, 8).alias(c) for c in ("es", "nes", "p", "fdr", "fwer")], F.size("leading_edge").alias("n_leading"))
