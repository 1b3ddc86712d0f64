"""Ontology closure, gene sets, enrichment and recovery reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions.special import hypergeom_tail
from verdure.operators import gsea
from verdure.operators.models import adjust_bh
from verdure.operators.ranks import first_per, rank_percentile
from verdure.storage import cut, uncut


def ancestor_lists(edges: DataFrame, keep: DataFrame | None = None, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestors) of every node of the edges: itself and all above it, each once, over all paths; of those in keep (ancestor) alone, if given, whatever lies between.

    A node holds what is less than 2^k steps above it (near) and what is just 2^k steps above (far). A round asks those that are far for both of their lists, so
    a path of n steps takes about log2 n rounds, a list crosses the network once for each node that asks, and pairs are never brought together in order to be told apart.
    Nodes with nothing far are done and not written again; those that nobody asks are not sent.
    """
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node IS NOT NULL AND ancestor IS NOT NULL")
    e = cut(e.distinct(), "edges")
    own = e.select("node").union(e.select("ancestor")).distinct()
    own = own.withColumn("near", F.array("node")) if keep is None else own.join(keep.select(F.col("ancestor").alias("node"), F.lit(True).alias("_k")).distinct(), "node", "left").select("node", F.when(F.col("_k"), F.array("node")).otherwise(F.array().cast(f"array<{dict(e.dtypes)['node']}>")).alias("near"))
    up = e.where("node <> ancestor").groupBy("node").agg(F.collect_list("ancestor").alias("far"))
    below = e.select(F.col("ancestor").alias("node"), F.lit(True).alias("asked")).distinct()
    now = own.join(up, "node", "left").join(below, "node", "left")
    now = cut(now.select("node", "near", F.coalesce("far", F.array().cast(dict(up.dtypes)["far"])).alias("far"), F.coalesce("asked", F.lit(False)).alias("asked")), "closure")
    uncut(e)
    done, asking, most, steps = now.where(F.size("far") == 0), now.where(F.size("far") > 0), now.count(), 1
    while steps < most and not asking.isEmpty():
        told = done.unionByName(asking).where(F.col("asked") & (F.size("near") + F.size("far") > 0)).select(F.col("node").alias("_to"), "near", "far")
        rows = asking.select(F.col("node").alias("_of"), F.explode("far").alias("_to")).join(told, "_to").select(F.col("_of").alias("node"), "near", "far", F.lit(False).alias("asked"))
        rows = rows.unionByName(asking.withColumn("far", F.slice("far", 1, 0))).repartition("node")
        met = rows.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.flatten(F.collect_list("far")).alias("far"), F.max("asked").alias("asked"))
        now = cut(met.select("node", "near", F.array_remove(F.array_except("far", "near"), F.col("node")).alias("far"), "asked"), "closure")
        done, asking, steps = done.unionByName(now.where(F.size("far") == 0)), now.where(F.size("far") > 0), 2 * steps
    return done.unionByName(asking).select("node", F.col("near").alias("ancestors"))


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor) over all paths, every node with itself, each pair once; cycles do no harm."""
    return ancestor_lists(edges, None, child, parent).select("node", F.explode("ancestors").alias("ancestor"))


def propagate(annotation: DataFrame, up: DataFrame, gene: str = "gene_id", term: str = "go_id") -> DataFrame:
    """(gene, term): annotations carried to all ancestors; terms without edges keep theirs."""
    far = annotation.join(up, F.col(term) == F.col("node")).select(gene, F.col("ancestor").alias(term))
    return far.unionByName(annotation.select(gene, term)).distinct()


def running_sum(ranked: DataFrame, members: DataFrame, gene: str = "gene_id", score: str = "score", term: str = "term", permutations: int = 0, seed: int = 42, smallest: int = 1, largest: int = 1 << 30) -> DataFrame:
    """(term, n_hits, es, nes, p): the largest deviation of the weighted running sum of each set down the ranking (score descending, gene ascending), as operators.gsea has it; genes count in upper case.
    Sets outside the limits, or without a gene in the list, have their number of genes alone; nes and p are null without permutations."""
    lst = cut(gsea.ranked_list(ranked, gene, score), "ranked")
    mine = members.select(F.col(term).alias("term"), F.upper(F.col(gene).cast("string")).alias("gene")).distinct()
    n = lst.count()
    found = mine.join(lst, "gene", "left").withColumn("n_hits", F.count("pos").over(Window.partitionBy("term")))
    inside = F.col("n_hits").between(max(smallest, 1), largest)
    out = gsea.enrichment_scores(found, n).select("term", "n_hits", F.when(inside, F.col("es")).alias("es"))
    if not permutations:
        return out.select("term", "n_hits", "es", F.lit(None).cast("double").alias("nes"), F.lit(None).cast("double").alias("p"))
    out = cut(out, "scores")
    null = gsea.null_scores(lst, out.where(inside), n, permutations, seed).select("n_hits", F.abs("es").alias("e"), (F.col("es") >= 0).alias("up"))
    both = out.withColumn("up", F.col("es") >= 0).join(null, ["n_hits", "up"], "left").groupBy("term", "n_hits", "es")
    s = both.agg(F.avg("e").alias("mean"), F.avg((F.col("e") >= F.abs("es")).cast("double")).alias("share"))
    return s.select("term", "n_hits", "es", (F.col("es") / F.col("mean")).alias("nes"), F.when(F.col("share").isNotNull(), F.greatest("share", F.lit(1.0 / permutations))).alias("p"))


def overlap_counts(members: DataFrame, background: DataFrame, drawn: DataFrame, term: str = "term", gene: str = "gene_id") -> DataFrame:
    """(term, k, n_set, n_drawn, n_all) of each set within the background."""
    bg, hits = background.select(gene).distinct(), drawn.select(gene).distinct().withColumn("_d", F.lit(1))
    size = bg.join(hits, gene, "left").agg(F.count("*").alias("n_all"), F.coalesce(F.sum("_d"), F.lit(0)).alias("n_drawn"))
    inside = members.select(term, gene).distinct().join(bg, gene).join(hits, gene, "left")
    return inside.groupBy(term).agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("k"), F.count("*").alias("n_set")).crossJoin(F.broadcast(size))


def over_representation(members: DataFrame, background: DataFrame, drawn: DataFrame, term: str = "term", gene: str = "gene_id") -> DataFrame:
    """overlap_counts with the hypergeometric p and adj_p."""

    @F.pandas_udf("double")
    def tail(k: pd.Series, a: pd.Series, s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hypergeom_tail(k, a, s, d))

    return adjust_bh(overlap_counts(members, background, drawn, term, gene).withColumn("p", tail("k", "n_all", "n_set", "n_drawn")))


def recovery(terms: DataFrame, expected: DataFrame, by: str = "norm", term: str = "go_id", fdr: str = "fdr", nes: str = "nes", threshold: float = 0.25) -> DataFrame:
    """expected (by, term) with rank, percentile, fdr, nes of each term and hit; nulls where the term is absent."""
    ranked = rank_percentile(terms, (by,), fdr, term)
    out = expected.join(ranked.select(by, term, fdr, nes, "term_rank", "n_terms", "percentile"), [by, term], "left")
    return out.withColumn("hit", F.coalesce((F.col(fdr) < threshold) & (F.col(nes) > 0), F.lit(False)))


def best_proxy(terms: DataFrame, up: DataFrame, roots: DataFrame, term: str = "go_id", fdr: str = "fdr") -> DataFrame:
    """For each root the row of the term itself, else of its descendant with the least fdr; proxy tells which."""
    down = roots.select(F.col(term).alias("root")).join(up, F.col("root") == F.col("ancestor")).select("root", F.col("node").alias(term)).join(terms, term)
    best = first_per(down.withColumn("proxy", F.col(term) != F.col("root")), ("root",), "proxy", fdr, term)
    return best
