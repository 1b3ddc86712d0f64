"""Linear models of a factorial design for every gene of a long matrix, with contrasts.

Samples that share all levels are one cell of the design. Of a gene the fit needs only how many values each cell holds, their
mean and their spread, which Spark aggregates before it shuffles; so what a gene brings together is bounded by the number of
cells, however many samples there are, and missing values are simply not counted. Genes with the same counts share one solution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.operators.models import moderated

FIT = "log_fc double, s2 double, df double, scale double, coefficients array<double>"


def model_matrix(cells: list[tuple], factors: tuple[str, ...], intercept: bool = False) -> tuple[np.ndarray, list[str]]:
    """(one row a cell, column names): the first factor by a column a level (without the first one's if there is an intercept), the others without their first level's; levels in order."""
    columns, names = [], []
    if intercept:
        columns.append(np.ones(len(cells)))
        names.append("(Intercept)")
    for k, f in enumerate(factors):
        levels = sorted({c[k] for c in cells})
        for v in levels if k == 0 and not intercept else levels[1:]:
            columns.append(np.array([float(c[k] == v) for c in cells]))
            names.append(f"{f}{v}")
    return np.stack(columns, 1) if columns else np.empty((len(cells), 0)), names


def linear_fit(m: DataFrame, samples: DataFrame, factors: tuple[str, ...], contrast: dict[str, float] | Callable[[list[str]], dict[str, float]], intercept: bool = False, gene: str = "gene_id") -> DataFrame:
    """(gene, log_fc, s2, df, scale, coefficients) by least squares of m (gene, sample_id, value) on factors of samples (sample_id, ...).

    contrast: weights by column name (or a function from the names to them); log_fc is its estimate and scale its unscaled standard
    error. Samples without a level of a factor, null and NaN values are left out. Where a gene's cells can't tell the contrast, log_fc
    and scale are null; without a degree of freedom s2 is null. coefficients is the shortest solution. Only the distinct cells reach the driver.
    """
    known = samples.select("sample_id", *[F.col(f).cast("string").alias(f) for f in factors]).dropna()
    cells = sorted(tuple(r) for r in known.select(*factors).distinct().collect())
    x, names = model_matrix(cells, factors, intercept)
    weights = contrast(names) if callable(contrast) else contrast
    if unknown := set(weights) - set(names):
        raise ValueError(f"no column {sorted(unknown)} among {names}")
    c = np.array([weights.get(k, 0.0) for k in names])
    solved: dict[bytes, tuple] = {}

    def solve(n: np.ndarray) -> tuple:
        key = n.tobytes()
        if key not in solved:
            there = n > 0
            root = np.sqrt(n[there])[:, None]
            inverse = np.linalg.pinv(root * x[there]) * root.T
            rank = np.linalg.matrix_rank(x[there]) if there.any() else 0
            estimable = np.allclose(c, c @ np.linalg.pinv(x[there]) @ x[there], atol=1e-8) if there.any() else False
            span = c @ inverse
            solved[key] = inverse, rank, estimable, float(np.sqrt((span**2 / n[there]).sum()))
        return solved[key]

    kind = dict(m.dtypes)[gene]

    def fit(batches):
        for batch in batches:
            rows = []
            for cell, count, mean, spread in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                n, y, within = np.zeros(len(x)), np.zeros(len(x)), sum(spread)
                n[cell], y[cell] = count, mean
                inverse, rank, estimable, scale = solve(n)
                there = n > 0
                b = inverse @ y[there]
                df = float(n.sum() - rank)
                rest = within + float((n[there] * (y[there] - x[there] @ b) ** 2).sum())
                rows.append((float(c @ b) if estimable else None, rest / df if df > 0 else None, df, scale if estimable else None, b.tolist()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.float64()) for v in cols[:4]), pa.array(cols[4], pa.list_(pa.float64()))], names=[gene, "log_fc", "s2", "df", "scale", "coefficients"])

    numbered = m.sparkSession.createDataFrame([(*t, k) for k, t in enumerate(cells)], T.StructType([*[T.StructField(f, T.StringType()) for f in factors], T.StructField("cell", T.IntegerType())]))
    at = known.join(numbered, list(factors)).select("sample_id", "cell")
    value = F.col("value").cast("double")
    sums = m.where(value.isNotNull() & ~F.isnan(value)).join(at, "sample_id").groupBy(gene, "cell").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("spread"))
    lists = sums.groupBy(gene).agg(F.collect_list(F.struct("cell", "n", "mean", "spread")).alias("s")).select(gene, *[F.col(f"s.{k}").alias(k) for k in ("cell", "n", "mean", "spread")])
    return lists.mapInArrow(fit, f"{gene} {kind}, {FIT}")


def last_less_first(target: str) -> Callable[[list[str]], dict[str, float]]:
    """The contrast of the last level of target against the first."""

    def weights(names: list[str]) -> dict[str, float]:
        own = [k for k in names if k.startswith(target)]
        return {own[-1]: 1.0, own[0]: -1.0}

    return weights


def differential(m: DataFrame, samples: DataFrame, target: str = "target", covariates: tuple[str, ...] = ("tissue",), gene: str = "gene_id") -> DataFrame:
    """(gene, t, log_fc, p, adj_p) of the last level of target against the first, on covariates with more than one level, with moderated variances.

    A gene without estimate or degree of freedom keeps its row with nulls and doesn't count in adj_p. Fewer than two levels of target are refused.
    """
    held = samples.where(" AND ".join(f"`{k}` IS NOT NULL" for k in (target, *covariates)))
    levels = held.agg(*[F.countDistinct(k).alias(k) for k in (target, *covariates)]).first()
    if levels[target] < 2:
        raise ValueError(f"{target} has fewer than two levels")
    fit = linear_fit(m, held, (target, *[k for k in covariates if levels[k] > 1]), last_less_first(target), gene=gene).drop("coefficients")
    ok = F.col("log_fc").isNotNull() & F.col("s2").isNotNull()
    good, rest = moderated(fit.where(ok)), fit.where(~ok)
    none = F.lit(None).cast("double")
    return good.select(gene, "t", "log_fc", "p", "adj_p").unionByName(rest.select(gene, none.alias("t"), "log_fc", none.alias("p"), none.alias("adj_p")))
