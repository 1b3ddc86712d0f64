"""Nearest neighbours of vectors: exactly, by blocks, or through an index of coarse cells; purity of classes by them.

The index has centres from a bounded sample; every vector is filed under its nearest centre, and a query looks into the cells of
its nearest centres alone. A cell with many vectors is parted, so that a crowd of equal vectors isn't one task's. What comes
out of a block or a part of a cell is the k nearest of it, and these are merged by query. `recall` tells what the index misses.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.storage import cut

#: Vectors in a part of a cell, at most about, and in a block as long as there are few blocks.
BLOCK = 4096
#: Vectors in a block at most about, and of these the queries and the others that are compared at once.
WIDE, ROWS, COLUMNS = 1 << 16, 512, 1 << 12
#: Vectors drawn for the centres.
SAMPLE = 20_000


def _matrix(t: pa.Table, column: str = "values") -> np.ndarray:
    flat = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0))


def _near(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of y of each row of x, the first of equally near ones.

    Products in single precision rule out what is farther than the k nearest by more than their rounding; the others' distances are worked out from differences in double precision.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        fine = np.isfinite(y).all(axis=1)
        middle = y[fine].mean(axis=0) if fine.any() else np.zeros(y.shape[1])
        own, size = (((z - middle) ** 2).sum(axis=1) for z in (x, y))
        scale = math.sqrt(max(own[np.isfinite(own)].max(initial=0), size[fine].max(initial=0))) or 1.0
        a, b = (((z - middle) / scale).astype(np.float32) for z in (x, y))
        own, size = own / scale**2, size / scale**2
        slack = (y.shape[1] + 8) * 2.0**-23 * (own + size[fine].max(initial=0)) + 1e-30
        flat, out = size.astype(np.float32), [(np.empty(0, np.intp), np.empty(0, np.intp), np.empty(0))]
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            limit, best = None, out[0]
            for lo in range(0, len(y), COLUMNS):
                d = a[part] @ b[lo : lo + COLUMNS].T
                d *= -2
                d += flat[lo : lo + COLUMNS]
                if limit is None:
                    limit = np.full(len(d), np.inf) if d.shape[1] < k else np.partition(d, k - 1, axis=1)[:, k - 1] + 2.0 * slack[part]
                    limit[np.isnan(limit)] = np.inf
                i, j = np.divmod(np.flatnonzero(d <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]), d.shape[1])
                if not len(i):
                    continue
                exact = np.concatenate([np.sqrt(((x[at + i[s : s + ROWS * 64]] - y[lo + j[s : s + ROWS * 64]]) ** 2).sum(axis=1)) for s in range(0, len(i), ROWS * 64)])
                i, j, exact = (np.concatenate(c) for c in zip(best, (i, lo + j, exact), strict=True))
                order = np.lexsort((j, exact, i))
                i = i[order]
                first = np.searchsorted(i, np.arange(len(d) + 1))
                keep = np.arange(len(i)) - first[i] < k
                best = i[keep], j[order][keep], exact[order][keep]
                full = np.flatnonzero(np.diff(first) >= k)
                limit[full] = np.minimum(limit[full], (exact[order][first[full] + k - 1] / scale) ** 2 - own[part][full] + slack[part][full])
            out.append((at + best[0], *best[1:]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _merged(queries: DataFrame, base: DataFrame, k: int, key: str) -> DataFrame:
    """(key, other, distance, rank): the k nearest of what meets in the same (_c, _p), by distance and then by id."""
    kind = dict(queries.dtypes)[key]

    def near(q: pa.Table, b: pa.Table) -> pa.Table:
        if q.num_rows and b.num_rows:
            b = b.take(pc.sort_indices(b.column("other")))
            i, j, d = _near(*(_matrix(z, c).astype(np.float64, copy=False) for z, c in ((q, "values"), (b, "vector"))), k)
            return pa.table({key: q.column(key).take(pa.array(i)), "other": b.column("other").take(pa.array(j)), "distance": d})
        return pa.table({key: q.column(key).slice(0, 0), "other": b.column("other").slice(0, 0), "distance": pa.array([], pa.float64())})

    base = base.select(F.col(key).alias("other"), F.col("values").alias("vector"), F.col("_c").alias("_bc"), F.col("_p").alias("_bp"))
    found = queries.groupBy("_c", "_p").cogroup(base.groupBy("_bc", "_bp")).applyInArrow(near, f"{key} {kind}, other {kind}, distance double")
    best = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k).alias("n"))  # k rows a block or part
    return best.select(key, F.posexplode("n").alias("p", "n")).select(key, F.col("n.other").alias("other"), F.col("n.distance").alias("distance"), (F.col("p") + 1).alias("rank"))


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, key: str = "sample_id") -> DataFrame:
    """(key, other, distance, rank) of each query's k nearest in base, all of it: blocks of queries against blocks of base."""
    few = math.isqrt(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1  # a vector is sent once for each block of the other side
    n, m = (max(1, -(-size // WIDE), min(-(-size // BLOCK), few)) for size in (queries.count(), base.count()))
    part = lambda d, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    q = queries.select(key, "values", part(queries, n).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_p"))
    b = base.select(key, "values", part(base, m).alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_c"))
    return _merged(q, b, k, key)


class Index:
    """Coarse cells over vectors (key, values). Centres are fitted on SAMPLE vectors at most, drawn by hash of the key; every vector is filed."""

    def __init__(self, base: DataFrame, cells: int | None = None, key: str = "sample_id", rounds: int = 10, seed: int = 0):
        self.key, n = key, base.count()
        cells = cells or max(1, int(np.sqrt(n)))
        some = base.orderBy(F.xxhash64(key, F.lit(seed))).limit(min(n, SAMPLE)).select("values").toPandas()
        x = np.stack(some["values"].to_numpy()) if len(some) else np.zeros((1, 1))
        c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].astype(float)
        for _ in range(rounds):
            at = self._near(x, c, 1)[:, 0]
            for j in np.unique(at).tolist():
                c[j] = x[at == j].mean(0)
        self.centres = np.unique(c, axis=0)
        filed = cut(self.filed(base, 1), "index")
        size = filed.groupBy("_c").agg(F.count("*").alias("_s"))
        self.parts = size.select("_c", F.ceil(F.col("_s") / BLOCK).cast("int").alias("_n"))
        self.base = filed.join(self.parts, "_c").withColumn("_p", F.pmod(F.xxhash64(key), F.col("_n")).cast("int")).drop("_n")

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
        d = -2 * x @ c.T + (c**2).sum(1)
        return np.argsort(d, axis=1, kind="stable")[:, :m]

    def filed(self, df: DataFrame, probes: int) -> DataFrame:
        """(key, values, _c): a row for each of the nearest cells."""
        centres, near, key = self.centres, self._near, self.key
        m = min(probes, len(centres))

        def run(batches):
            for batch in batches:
                at = near(_matrix(pa.Table.from_batches([batch])), centres, m) if batch.num_rows else np.empty((0, m), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.tolist(), pa.list_(pa.int32()))], names=[key, "values", "_c"])

        kind = dict(df.dtypes)
        return df.select(key, F.col("values").cast("array<double>")).mapInArrow(run, f"{key} {kind[key]}, values array<double>, _c array<int>").withColumn("_c", F.explode("_c"))

    def nearest(self, queries: DataFrame, k: int = 5, probes: int = 4) -> DataFrame:
        """(key, other, distance, rank) of each query's k nearest in the cells it looks into; fewer where those hold fewer."""
        q = self.filed(queries, probes).join(self.parts, "_c").select(self.key, "values", "_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_p"))
        return _merged(q, self.base, k, self.key)


    def probes_for(self, base: DataFrame, k: int = 5, least: float = 0.9, sample: int = 300) -> int:
        """The smallest power of two of cells to look into with which a hash sample of base finds at least this share (and a little) of its exact neighbours; all cells find all."""
        some = base.orderBy(F.xxhash64(self.key, F.lit(1))).limit(sample).select(self.key, "values")
        exact, p = cut(nearest(some, base, k, self.key), "exact"), 1
        while p < len(self.centres) and recall(self.nearest(some, k, p), exact, self.key) < min(1.0, least + 0.03):
            p *= 2
        return min(p, len(self.centres))


def recall(found: DataFrame, exact: DataFrame, key: str = "sample_id") -> float:
    """The share of the exact neighbours that were found."""
    hit = exact.join(found.select(key, "other").withColumn("_h", F.lit(1)), [key, "other"], "left")
    return float(hit.agg(F.coalesce(F.avg(F.coalesce("_h", F.lit(0))), F.lit(1.0)).alias("r")).first().r)


def two_fold_purity(v: DataFrame, fold: Column, k: int = 5, label: str = "class", key: str = "sample_id", probes: int | None = None, cells: int | None = None) -> DataFrame:
    """(fold, n, accuracy): how often the most frequent class (the smallest of equals) of the k nearest in the other fold is a vector's own.

    v: key, values and label; fold gives 0 or 1. Classes of a single vector are left out. probes: through an index, else exactly.
    """
    sizes = v.groupBy(label).agg(F.count("*").alias("_n")).where("_n > 1").select(label)
    d = v.join(sizes, label, "left_semi").select(key, F.col("values").cast("array<double>").alias("values"), label, fold.cast("int").alias("fold"))
    parts = []
    for f in (0, 1):
        mine, other = d.where(F.col("fold") == f), d.where(F.col("fold") == 1 - f)
        n = nearest(mine, other, k, key) if probes is None else Index(other, cells, key).nearest(mine, k, probes)
        votes = n.join(other.select(F.col(key).alias("other"), F.col(label).alias("_v")), "other").groupBy(key, "_v").agg(F.count("*").alias("_c"))
        said = votes.groupBy(key).agg(F.min(F.struct(-F.col("_c"), "_v"))["_v"].alias("_v"))
        parts.append(mine.join(said, key, "left").groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("_v") == F.col(label), F.lit(False)).cast("int")).alias("accuracy")))
    return parts[0].unionByName(parts[1])
