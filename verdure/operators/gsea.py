"""Gene set enrichment of a ranked list: running sums, permutation nulls, pooled FDR, leading edges.

The list is numbered by ranges of its score, so no task sorts it whole. A set's running sum needs its own hits alone. The
null of a set size is drawn a range of the list at a time: how many hits fall into each range is drawn from the sizes of the
ranges, where they fall is drawn within the range, each from a seed of its own, so that tasks agree without talking. One
pass sums the weights of each draw by range; with the sums before a range and of the whole, a second pass finds the range's
highest and lowest point, and the extreme of a draw is that of its ranges. A task holds the weights of one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.operators.ranks import ranges
from verdure.storage import cut

#: Genes of a range of the list, and permutations drawn together.
RANGE, DRAWS = 1 << 16, 100


def ranked_list(df: DataFrame, gene: str = "gene_id", score: str = "score") -> DataFrame:
    """(gene, weight, pos): distinct genes in upper case, each at its best score, from the highest score down (ties by gene); weight is the absolute score. Null and NaN scores are left out."""
    best = df.where(F.col(gene).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(F.upper(F.col(gene).cast("string")).alias("gene")).agg(F.max(F.col(score).cast("double")).alias("_s"))
    d, ends = ranges(best, "_s", "_b")
    down = Window.partitionBy("_b").orderBy(F.desc("_s"), "gene")
    d = d.join(F.broadcast(ends), "_b")  # one row a range
    return d.select("gene", F.abs("_s").alias("weight"), (F.col("_n") - F.col("_upto") + F.row_number().over(down) - 1).cast("long").alias("pos"))


def hits(ranked: DataFrame, members: DataFrame, gene: str = "gene_id", term: str = "term", smallest: int = 70, largest: int = 782) -> DataFrame:
    """(term, gene, pos, weight, n_hits) of the sets with so many genes in the list."""
    sets = members.select(F.col(term).alias("term"), F.upper(F.col(gene).cast("string")).alias("gene")).distinct().join(ranked, "gene")
    return sets.withColumn("n_hits", F.count("*").over(Window.partitionBy("term"))).where(F.col("n_hits").between(smallest, largest)).select("term", "gene", "pos", "weight", "n_hits")


def enrichment_scores(found: DataFrame, n: int) -> DataFrame:
    """(term, n_hits, es, leading_edge): the largest deviation of each set's running sum (the high one where both are as large) and the genes up to it, or from it on where it is low. Rows without pos keep their set in the result and count for nothing."""
    w = Window.partitionBy("term").orderBy(F.asc_nulls_last("pos"))
    k, total = F.row_number().over(w) - 1, F.sum("weight").over(Window.partitionBy("term"))
    up = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0))
    gap = (F.col("pos") - k) / F.greatest(F.lit(n) - F.col("n_hits"), F.lit(1))
    d = found.select("term", "gene", "pos", "n_hits", (share(up) - gap).alias("high"), (share(up - F.col("weight")) - gap).alias("low"))
    hit = F.col("pos").isNotNull()
    top = d.groupBy("term", "n_hits").agg(F.max(F.when(hit, F.struct("high", (-F.col("pos")).alias("p")))).alias("h"), F.min(F.when(hit, F.struct("low", F.col("pos").alias("p")))).alias("l"), F.collect_list(F.when(hit, F.struct("pos", "gene"))).alias("g"))
    high = F.col("h.high") >= -F.col("l.low")
    edge = F.filter("g", lambda x: F.when(high, x["pos"] <= -F.col("h.p")).otherwise(x["pos"] >= F.col("l.p")))
    return top.select("term", "n_hits", F.when(high, F.col("h.high")).otherwise(F.col("l.low")).alias("es"), F.transform(F.array_sort(edge), lambda x: x["gene"]).alias("leading_edge"))


def draw(n: int, hits: int, seed: int, permutation: int, at: int, size: int = RANGE) -> np.ndarray:
    """Places, ascending, within range number `at` of a random set of so many of n genes."""
    whole, over = divmod(n, size)
    parts = [size] * whole + [over] * (over > 0)
    count = np.random.default_rng([seed, hits, permutation]).multivariate_hypergeometric(parts, hits, method="marginals")[at] if len(parts) > 1 else hits
    return np.sort(np.random.default_rng([seed, hits, permutation, at]).choice(parts[at], count, replace=False))


def null_scores(ranked: DataFrame, sizes: DataFrame, n: int, permutations: int = 1000, seed: int = 42, size: int = RANGE) -> DataFrame:
    """(n_hits, permutation, es) of random sets of each size in sizes (n_hits). Work is dealt by range of the list and batch of draws."""
    parts, batches = -(-n // size), -(-permutations // DRAWS)
    spread = max(1, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(parts, 1))
    lists = ranked.groupBy(F.floor(F.col("pos") / size).cast("int").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "weight"))), lambda x: x["weight"]).alias("w"))
    lists = lists.select("at", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("lane"), "w")
    work = sizes.select("n_hits").distinct().select("n_hits", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("at"))
    work = work.withColumn("lane", F.pmod(F.xxhash64("n_hits", "batch"), F.lit(spread)).cast("int"))

    def each(w: pa.Table, todo: pa.Table):
        weight = np.asarray(w.column("w")[0].values) if w.num_rows else np.empty(0)
        for row in todo.to_pylist():
            for p in range(row["batch"] * DRAWS, min(permutations, (row["batch"] + 1) * DRAWS)):
                yield row, p, weight, draw(n, row["n_hits"], seed, p, row["at"], size)

    def sums(w: pa.Table, todo: pa.Table) -> pa.Table:
        rows = [(r["n_hits"], r["batch"], p, r["at"], len(x), float(weight[x].sum())) for r, p, weight, x in each(w, todo)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], names=["n_hits", "batch", "permutation", "at", "k", "sum"])

    def peaks(w: pa.Table, todo: pa.Table) -> pa.Table:
        rows = []
        for r, p, weight, x in each(w, todo):
            if len(x):
                i = p - r["batch"] * DRAWS
                k = r["k"][i] + np.arange(len(x))
                gap = (r["at"] * size + x - k) / max(n - r["n_hits"], 1)
                up = r["before"][i] + np.cumsum(weight[x])
                total = r["total"][i]
                share = (lambda v: v / total) if total > 0 else np.zeros_like  # noqa: B023
                rows.append((r["n_hits"], p, float((share(up) - gap).max()), float((share(up - weight[x]) - gap).min())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], names=["n_hits", "permutation", "high", "low"])

    held = lists.groupBy("at", "lane")
    s = held.cogroup(work.groupBy("at", "lane")).applyInArrow(sums, "n_hits long, batch int, permutation int, at int, k long, sum double")
    each_draw = Window.partitionBy("n_hits", "permutation")
    before = each_draw.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("n_hits", "batch", "permutation", "at", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k"), F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("before"), F.sum("sum").over(each_draw).alias("total"))
    s = s.groupBy("n_hits", "batch", "at").agg(F.array_sort(F.collect_list(F.struct("permutation", "k", "before", "total"))).alias("d"))
    s = s.select("n_hits", "batch", "at", *[F.col(f"d.{c}").alias(c) for c in ("k", "before", "total")]).withColumn("lane", F.pmod(F.xxhash64("n_hits", "batch"), F.lit(spread)).cast("int"))
    found = held.cogroup(s.groupBy("at", "lane")).applyInArrow(peaks, "n_hits long, permutation int, high double, low double")
    ends = found.groupBy("n_hits", "permutation").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return ends.select("n_hits", "permutation", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("es"))


def _share_beyond(points: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """points with the share of the weight of all points that lies at their value or beyond, by ranges of the value; value >= 0."""
    d, _ = ranges(points, value, "_b")
    per = d.groupBy("_b").agg(F.sum(weight).alias("_w"))
    up = Window.orderBy(F.desc("_b"))
    per = per.select("_b", F.coalesce(F.sum("_w").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"), F.sum("_w").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    w = Window.partitionBy("_b").orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return d.join(F.broadcast(per), "_b").withColumn(out, (F.col("_above") + F.sum(weight).over(w)) / F.col("_all")).drop("_b", "_above", "_all")


def prerank(ranking: DataFrame, members: DataFrame, gene: str = "gene_id", score: str = "score", term: str = "term", permutations: int = 1000, seed: int = 42, smallest: int = 70, largest: int = 782, size: int = RANGE) -> DataFrame:
    """(term, go_id, n_hits, es, nes, p, fdr, fwer, leading_edge), highest es first.

    nes: es over the mean of the draws of its size on its side of zero; p: the share of those at or beyond it; fdr: the share of all sets'
    draws (normalised alike) at or beyond it over the share of all sets at or beyond it, 1 at most; fwer: the share of permutations whose
    extreme over all sizes is at or beyond it. p, fdr and fwer are 1 / permutations at least. go_id: the first word of term.
    A set without draws on its side has nulls there.
    """
    ranked = cut(ranked_list(ranking, gene, score), "ranked")
    found = cut(hits(ranked, members, gene, term, smallest, largest), "hits")
    n = ranked.count()
    sets = cut(enrichment_scores(found, n), "sets")
    side = (F.col("es") >= 0).alias("up")
    null = cut(null_scores(ranked, found, n, permutations, seed, size), "null").select("n_hits", "permutation", "es", side)
    mean = null.groupBy("n_hits", "up").agg(F.avg(F.abs("es")).alias("mean"))
    sets = sets.select("*", side).join(mean, ["n_hits", "up"], "left").withColumn("x", F.abs("es") / F.col("mean"))
    of_size = sets.groupBy("n_hits").agg(F.count("*").alias("times"))
    null = null.join(mean, ["n_hits", "up"]).join(of_size, "n_hits").select("n_hits", "permutation", "es", "up", (F.abs("es") / F.col("mean")).alias("x"), "times")
    beyond = sets.select("term", "n_hits", F.abs("es").alias("at"), "up").join(null.select("n_hits", "up", F.abs("es").alias("e")), ["n_hits", "up"])
    p = beyond.groupBy("term").agg(F.avg((F.col("e") >= F.col("at")).cast("double")).alias("p"))
    most = null.groupBy("permutation", "up").agg(F.max("x").alias("x")).groupBy("up").agg(F.collect_list("x").alias("most"))  # a number a permutation
    shares = []
    for up in (True, False):
        own = sets.where((F.col("up") == up) & F.col("x").isNotNull()).select("term", "x", F.lit(0).alias("draws"), F.lit(1).alias("sets"))
        both = own.unionByName(null.where(F.col("up") == up).select(F.lit(None).cast(dict(sets.dtypes)["term"]).alias("term"), "x", F.col("times").alias("draws"), F.lit(0).alias("sets")))
        of_draws = _share_beyond(both, "x", "draws", "of_draws")
        shares.append(_share_beyond(of_draws, "x", "sets", "of_sets").where("sets = 1").select("term", F.least(F.lit(1.0), F.col("of_draws") / F.col("of_sets")).alias("fdr")))
    out = sets.join(p, "term", "left").join(shares[0].unionByName(shares[1]), "term", "left").join(F.broadcast(most), "up", "left")
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(1.0 / permutations)))
    fwer = F.when(F.col("x").isNotNull(), F.size(F.filter("most", lambda v: v >= F.col("x"))) / F.size("most"))
    out = out.select("term", F.element_at(F.split(F.col("term").cast("string"), " "), 1).alias("go_id"), "n_hits", "es", F.when(F.col("up"), F.col("x")).otherwise(-F.col("x")).alias("nes"), floor(F.col("p")).alias("p"), floor(F.col("fdr")).alias("fdr"), floor(fwer).alias("fwer"), "leading_edge")
    return out.orderBy(F.desc("es"), "term")
