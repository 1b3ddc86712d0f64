"""Leading directions of a tall matrix (genes in rows, samples in columns), and Rank-In by them.

Only products with a few directions at a time are taken over the genes: a task turns its rows into one samples x directions
sum, and the sums are added up by blocks of samples. The directions are gathered in a Krylov basis until those that are wanted
stand still. So nothing grows with the number of genes, and nowhere is there a samples x samples matrix unless as
many directions as samples are wanted; the driver and each task hold samples x (directions in the basis).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators.ranks import rank_bins
from verdure.storage import cut

#: Samples whose sums are added up together.
BLOCK = 256


def wide_rows(cells: DataFrame, value: str, gene: str = "gene_id", sample: str = "sample_id", carry: tuple[str, ...] = ()) -> tuple[DataFrame, list]:
    """((gene, i, v, ...) with each gene's values and their samples' places, written; the samples in order). carry: columns of the cells that become arrays beside v. The samples reach the driver."""
    names = sorted(r[0] for r in cells.select(sample).distinct().collect())
    kind = dict(cells.dtypes)[sample]
    index = cells.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"{sample} {kind}, _i int")
    rows = cells.join(index, sample).groupBy(gene).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(value).cast("double").alias("v"), *carry))).alias("c"))
    return cut(rows.select(gene, F.col("c._i").alias("i"), F.col("c.v").alias("v"), *[F.col(f"c.{k}").alias(k) for k in carry]), "rows"), names


def product(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    """A'A w for rows (i, v) of A, summed over tasks and then over blocks of samples."""
    n, l = w.shape

    def partial(batches):
        total = np.zeros((n, l))
        for batch in batches:
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                at, x = i.values.to_numpy(), v.values.to_numpy()
                total[at] += np.outer(x, x @ w[at])
        yield pa.RecordBatch.from_arrays([pa.array(range(0, n, BLOCK), pa.int32()), pa.array([total[k : k + BLOCK].tobytes() for k in range(0, n, BLOCK)], pa.binary())], names=["block", "sum"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sum"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.select("i", "v").mapInArrow(partial, "block int, sum binary").repartition(parts, "block").mapInArrow(added, "block int, sum binary")
    out = np.zeros((n, l))
    for r in sums.toLocalIterator():
        out[r.block : r.block + BLOCK] = np.frombuffer(r.sum).reshape(-1, l)
    return out


def directions(rows: DataFrame, n: int, k: int | None = None, share: float | None = None, width: int | None = None, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, directions as columns) of rows (i, v) over n samples: the first k, or as many as hold this share of the sum of squares.

    Each pass over the rows adds up to `width` directions to the basis; passes end when the residuals of those wanted are below
    tolerance x the largest, or the basis holds all. A matrix of zeros has no directions.
    """
    whole = rows.select(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("s")).first().s or 0.0
    if whole <= 0 or n == 0:
        return np.empty(0), np.empty((n, 0))
    width = min(n, width or max((k or 0) + 6, 16))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    basis, image = np.empty((n, 0)), np.empty((n, 0))
    while True:
        basis, image = np.hstack([basis, w]), np.hstack([image, product(rows, w)])
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = np.maximum(theta[::-1], 0), s[:, ::-1]
        wanted = k if share is None else int(np.searchsorted(np.cumsum(theta), share * whole * (1 - 1e-12))) + 1
        rest = image - basis @ (basis.T @ image[:, :])
        new = rest[:, -w.shape[1] :]
        new = new - basis @ (basis.T @ new)
        q, size, _ = np.linalg.svd(new, full_matrices=False)
        q = q[:, size > 1e-10 * theta[0]]
        full = basis.shape[1] >= n or not q.shape[1]
        if full or wanted <= len(theta):
            m = min(wanted, len(theta))
            gap = np.linalg.norm(image @ s[:, :m] - basis @ s[:, :m] * theta[:m], axis=0)
            if full or (gap <= tolerance * theta[0]).all():
                return np.sqrt(theta[:m]), basis @ s[:, :m]
        w = q[:, : n - basis.shape[1]]


def projected(rows: DataFrame, u: np.ndarray, out: str = "p") -> DataFrame:
    """rows with an array beside v: the part of v along the directions u."""
    names = rows.columns
    at = [names.index("i"), names.index("v")]
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            parts = []
            for i, v in zip(batch.column(at[0]), batch.column(at[1]), strict=True):
                own = u[i.values.to_numpy()]
                parts.append(own @ (own.T @ v.values.to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.float64()))], names=[*names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def rank_in_truncated(m: DataFrame, n_bins: int = 100, share: float = 0.95) -> DataFrame:
    """(gene_id, sample_id, value): rank bins within samples, of which only the leading directions are kept that hold `share` of their spread around the genes' means.

    m: gene_id, sample_id, value; null and NaN values are left out and count as their gene's mean. Without spread the means are returned.
    The directions are those over genes or over samples, whichever are fewer (the cells that are kept are the same), so tasks hold the fewer x directions.
    """
    r = rank_bins(m, n_bins, "value", ("sample_id",), "r").where("r IS NOT NULL")
    mean = r.groupBy("gene_id").agg(F.avg("r").alias("mean"))
    cells = r.join(mean, "gene_id").select("gene_id", "sample_id", (F.col("r") - F.col("mean")).alias("c"), "mean")
    few, many = ("gene_id", "sample_id") if m.select("gene_id").distinct().count() <= m.select("sample_id").distinct().count() else ("sample_id", "gene_id")
    rows, names = wide_rows(cells, "c", gene=many, sample=few, carry=("mean",))
    _, u = directions(rows, len(names), share=share)
    index = m.sparkSession.createDataFrame(list(zip(range(len(names)), names, strict=True)), f"i int, {few} {dict(m.dtypes)[few]}")
    back = projected(rows, u).select(many, F.explode(F.arrays_zip("i", "p", "mean")).alias("x")).select(many, "x.i", (F.col("x.p") + F.col("x.mean")).alias("value"))
    return back.join(index, "i").select("gene_id", "sample_id", "value")
