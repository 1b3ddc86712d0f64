"""Batch correction, Rank-In and differential expression over long matrices.

Samples are a dimension (thousands); genes and cells are what grows. Designs are made on the driver from the
sample table, sent to tasks, and applied to groups of genes; sums over genes are Spark aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions.special import digamma, t_two_sided, trigamma, trigamma_inverse
from verdure.operators import spectral
from verdure.operators.ranks import center, group_ranges, ranges, weighted_ranks

def _levels(values: pd.Series) -> np.ndarray:
    return pd.get_dummies(values.astype(str), dtype=float).to_numpy()


def combat(m: DataFrame, samples: DataFrame, batch: str = "study_id", covariates: tuple[str, ...] = (), genes_a_group: int = 512) -> DataFrame:
    """m (gene_id, sample_id, value) with batch effects taken off by parametric empirical Bayes.

    Covariates with one level are left out. Batches of one sample and missing cells are refused; genes without
    variance pass unchanged.
    """
    s = samples.select("sample_id", batch, *covariates).toPandas().sort_values("sample_id").reset_index(drop=True)
    if s[batch].value_counts().min() < 2:
        raise ValueError("every batch needs two samples")
    b = _levels(s[batch])
    x = np.column_stack([b, *(_levels(s[c])[:, 1:] for c in covariates if s[c].nunique() > 1)])
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("batches and covariates are confounded")
    solve, share, place = np.linalg.pinv(x), b.mean(axis=0), {k: i for i, k in enumerate(s["sample_id"])}
    n_batch = b.shape[1]

    def standardise(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="gene_id", columns="sample_id", values="value").reindex(columns=s["sample_id"])
        y = wide.to_numpy(float)
        if np.isnan(y).any():
            raise ValueError("a gene has missing cells")
        beta = y @ solve.T
        mean = (beta[:, :n_batch] @ share)[:, None] + beta[:, n_batch:] @ x[:, n_batch:].T
        sd = np.sqrt(((y - beta @ x.T) ** 2).mean(axis=1))[:, None] + np.zeros_like(y)
        z = (y - mean) / np.where(sd > 1e-12, sd, 1)
        return pd.DataFrame({"gene_id": np.repeat(wide.index.to_numpy(), len(s)), "sample_id": np.tile(s["sample_id"].to_numpy(), len(wide)), "value": y.ravel(), "z": z.ravel(), "sd": sd.ravel(), "mean": (mean + np.zeros_like(y)).ravel()})

    kinds = dict(m.dtypes)
    m = m.select("gene_id", "sample_id", F.col("value").cast("double"))
    if x.shape[1] == n_batch:  # means and spreads by batch are the whole fit
        cells = _standardised_by_batch(m.join(F.broadcast(samples.select("sample_id", F.col(batch).alias("_b"))), "sample_id"), len(s))
    else:
        groups = F.pmod(F.xxhash64("gene_id"), F.lit(1 << 30)) % max(1, m.select("gene_id").distinct().count() // genes_a_group)
        cells = m.groupBy(groups.alias("g")).applyInPandas(standardise, f"gene_id {kinds['gene_id']}, sample_id {kinds['sample_id']}, value double, z double, sd double, mean double")
        cells = cells.join(F.broadcast(samples.select("sample_id", F.col(batch).alias("_b"))), "sample_id")
    stats = cells.where("sd > 1e-12").groupBy("gene_id", "_b").agg(F.count("*").alias("n"), F.avg("z").alias("g"), F.var_samp("z").alias("d"))
    prior = stats.groupBy("_b").agg(F.avg("g").alias("gbar"), F.coalesce(F.var_samp("g"), F.lit(0.0)).alias("t2"), F.avg("d").alias("dm"), F.coalesce(F.var_samp("d"), F.lit(0.0)).alias("dv"))
    stats = stats.join(F.broadcast(prior), "_b")

    @F.pandas_udf("g double, d double")
    def shrink(n: pd.Series, g: pd.Series, d: pd.Series, gbar: pd.Series, t2: pd.Series, dm: pd.Series, dv: pd.Series) -> pd.DataFrame:
        dv = np.maximum(dv, 1e-12)
        a, bb = (2 * dv + dm**2) / dv, (dm * dv + dm**3) / dv
        gs, ds = g.copy(), np.maximum(d, 1e-12)
        for _ in range(500):
            new = (n * t2 * g + ds * gbar) / np.maximum(n * t2 + ds, 1e-300)
            dn = (0.5 * ((n - 1) * d + n * (g - new) ** 2) + bb) / (n / 2 + a - 1)
            moved = max((np.abs(new - gs) / np.maximum(np.abs(gs), 1e-12)).max(), (np.abs(dn - ds) / ds).max())
            gs, ds = new, dn
            if moved < 1e-4:
                break
        return pd.DataFrame({"g": gs, "d": ds})

    fit = stats.select("gene_id", "_b", shrink("n", "g", "d", "gbar", "t2", "dm", "dv").alias("f"))
    out = cells.join(fit, ["gene_id", "_b"], "left")
    fixed = F.col("sd") * (F.col("z") - F.col("f.g")) / F.sqrt("f.d") + F.col("mean")
    return out.select("gene_id", "sample_id", F.coalesce(fixed, F.col("value")).alias("value"))


def _standardised_by_batch(cells: DataFrame, n_samples: int) -> DataFrame:
    """cells (gene_id, sample_id, _b, value) with z, sd, mean: of a gene only the sums by batch are brought together. A gene without a value for each sample is an error."""
    by = cells.groupBy("gene_id", "_b").agg(F.count(F.nanvl("value", F.lit(None))).alias("_k"), F.count("*").alias("_rows"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    k = F.sum("_k")
    gene = by.groupBy("gene_id").agg((F.sum(F.col("_k") * F.col("_m")) / k).alias("mean"), F.sqrt(F.sum(F.col("_k") * F.col("_v")) / k).alias("sd"), k.alias("_k"), F.sum("_rows").alias("_rows"))
    whole = (F.col("_k") == n_samples) & (F.col("_rows") == n_samples)
    gene = gene.select("gene_id", F.when(whole, F.col("mean")).otherwise(F.raise_error(F.lit("a gene has missing cells")).cast("double")).alias("mean"), "sd")
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)
    return cells.join(gene, "gene_id").select("gene_id", "sample_id", "value", z.alias("z"), "sd", "mean", "_b")


def rank_in(m: DataFrame, n_bins: int = 100, k: int | None = None, k_max: int = 10, by: str = "class") -> DataFrame:
    """Rank-In: weighted ranks less the k leading directions of what is left after class means.

    m: gene_id, sample_id, value, class. A missing class or fewer than two classes is refused; k is held to
    min(k_max, samples - 1, genes - 1), and by default is where, of that many singular values, the ratio of successive
    ones is largest. The directions come from operators.spectral: no samples x samples matrix is made.
    """
    check = m.agg(F.count_if(F.col(by).isNull()).alias("missing"), F.countDistinct(by).alias("n"), F.countDistinct("sample_id").alias("s"), F.countDistinct("gene_id").alias("g")).first()
    if check.missing:
        raise ValueError("samples without a class")
    if check.n < 2:
        raise ValueError("two classes at least")
    w = center(weighted_ranks(m, n_bins), ("gene_id", by), "weighted", "left")
    rows, names = spectral.wide_rows(w, "left", carry=("weighted",))
    n = len(names)
    most = max(1, min(k_max, check.s - 1, check.g - 1))
    sv, vectors = spectral.directions(rows, n, k=most)
    if k is None:
        k = int(np.argmax(sv[:-1] / (sv[1:] + 1e-12))) + 1 if len(sv) > 1 else 1
    off = spectral.projected(rows, vectors[:, : min(k, most)])
    kind = dict(m.dtypes)["sample_id"]
    index = m.sparkSession.createDataFrame(list(zip(range(n), names, strict=True)), f"i int, sample_id {kind}")
    cells = off.select("gene_id", F.explode(F.arrays_zip("i", "weighted", "p")).alias("x")).select("gene_id", "x.i", (F.col("x.weighted") - F.col("x.p")).alias("value"))
    return cells.join(index, "i").select("gene_id", "sample_id", "value")


def adjust_bh(df: DataFrame, p: str = "p", by: tuple[str, ...] = (), out: str = "adj_p", rows: int | None = None) -> DataFrame:
    """Benjamini-Hochberg within `by`: the least of p m / rank from a row's rank on; NULL p stay NULL and don't count.

    Rows are ranked from the largest p down, so the frame only grows. Rows are dealt into ranges of p (of a group, if it has more than
    `rows` rows); the rows and the least value of the ranges above are added by a join with one row a range.
    """
    if not by:
        d, ends = ranges(df, p, "_b")
        w = Window.partitionBy("_b").orderBy(F.desc(p))
        d = d.join(F.broadcast(ends), "_b", "left").withColumn("_v", F.col(p) * F.col("_n") / (F.col("_upto") - F.row_number().over(w) + 1))
        least = d.groupBy("_b").agg(F.min("_v").alias("_m")).withColumn("_above", F.min("_m").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
        d = d.join(F.broadcast(least.select("_b", "_above")), "_b", "left")
        run = F.least(F.lit(1.0), F.min("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_above")
        return d.withColumn(out, F.when(F.col(p).isNotNull(), run)).drop("_b", "_n", "_upto", "_v", "_above")
    d = group_ranges(df.where(F.col(p).isNotNull()), p, by, rows)
    w = Window.partitionBy(*by, "_b")
    d = d.withColumn("_v", F.col(p) * F.col("_n") / (F.col("_before") + F.count("*").over(w) - F.row_number().over(w.orderBy(F.desc(p))) + 1))
    least = d.groupBy(*by, "_b", "_n").agg(F.min("_v").alias("_m"), F.count("*").alias("_k")).where("_k < _n")  # of groups that are cut
    above = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(least.select(*by, "_b", F.min("_m").over(above).alias("_above")), [*by, "_b"], "left")
    run = F.least(F.lit(1.0), F.min("_v").over(w.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_above")
    d = d.withColumn(out, run).select(*df.columns, out)
    return d.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def two_groups(m: DataFrame, treated: str = "treated", by: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """(by, log_fc, s2, df, scale): difference of means, pooled variance and its degrees of freedom; groups of two rows at least."""
    a, b = F.when(F.col(treated), F.col("value")), F.when(~F.col(treated), F.col("value"))
    s = m.groupBy(*by).agg(*(f(c).alias(k + n) for n, c in (("1", a), ("0", b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp)))).where("n1 > 1 AND n0 > 1")
    df = F.col("n1") + F.col("n0") - 2
    s2 = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / df
    return s.select(*by, (F.col("m1") - F.col("m0")).alias("log_fc"), s2.alias("s2"), df.cast("double").alias("df"), F.sqrt(1 / F.col("n1") + 1 / F.col("n0")).alias("scale"))


def moderated(fit: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """fit with t, p and adj_p by empirical Bayes variances (one prior for all rows)."""
    ok = fit.where("s2 > 0")
    stats = ok.select(F.log("s2").alias("z"), "df").groupBy("df").agg(F.count("*").alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") ** 2).alias("q")).toPandas()
    n = stats["n"].sum()
    shift = np.log(stats["df"] / 2) - digamma(stats["df"] / 2)
    e = float((stats["s"] + stats["n"] * shift).sum() / max(n, 1))
    var = float((stats["q"] + 2 * shift * stats["s"] + stats["n"] * shift**2).sum() / max(n, 1) - e * e) * n / max(n - 1, 1)
    extra = var - float((trigamma(stats["df"] / 2) * stats["n"]).sum() / max(n, 1))
    d0 = 2 * trigamma_inverse(extra) if extra > 0 else math.inf
    s0 = math.exp(e + (float(digamma(d0 / 2)) - math.log(d0 / 2) if math.isfinite(d0) else 0.0)) if n else 1.0
    post = F.lit(s0) if math.isinf(d0) else (F.lit(d0 * s0) + F.col("df") * F.col("s2")) / (F.lit(d0) + F.col("df"))
    total = F.lit(1e6) if math.isinf(d0) else F.col("df") + F.lit(d0)

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t, df))

    out = fit.withColumn("t", F.col("log_fc") / (F.sqrt(post) * F.col("scale"))).withColumn("p", p_value("t", total))
    return adjust_bh(out, "p", by)
