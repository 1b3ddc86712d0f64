"""Components, clusters and classifiers of samples: principal components without a genes x genes matrix, k-means against labels, cross-validated regression."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators import distance, spectral


def principal_components(m: DataFrame, k: int | None = None, share: float | None = None) -> tuple[DataFrame, np.ndarray]:
    """((sample_id, scores), shares of the variance) of a long matrix centred by gene: the first k components, or as many as hold this share.

    A component points to where its largest loading (the first of equals) is positive. A missing cell counts as its gene's mean.
    """
    mean = m.groupBy("gene_id").agg(F.avg("value").alias("_m"))
    cells = m.join(mean, "gene_id").select("gene_id", "sample_id", (F.col("value") - F.col("_m")).alias("c"))
    rows, names = spectral.wide_rows(cells, "c", gene="sample_id", sample="gene_id")
    whole = rows.select(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    sv, u = spectral.directions(rows, len(names), k=None if k is None else min(k, len(names)), share=share)
    if u.shape[1]:
        u = u * np.sign(u[np.argmax(np.round(np.abs(u), 9), axis=0), np.arange(u.shape[1])])
    kind = dict(rows.dtypes)["sample_id"]

    def run(batches):
        for batch in batches:
            scores = [v.values.to_numpy() @ u[i.values.to_numpy()] for i, v in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.list_(pa.float64()))], names=["sample_id", "scores"])

    return rows.select("sample_id", "i", "v").mapInArrow(run, f"sample_id {kind}, scores array<double>"), sv**2 / whole if whole else sv


def clusters_against(v: DataFrame, label: str = "class", k: int | None = None, seed: int = 42) -> DataFrame:
    """(k, ari): k-means of vectors (values, label), k as many as there are classes unless given, and its adjusted Rand index against them."""
    k = k or v.select(label).distinct().count()
    d = v.withColumn("features", array_to_vector(F.col("values").cast("array<double>")))
    found = KMeans(k=k, seed=seed, maxIter=20).fit(d).transform(d) if k > 1 else d.withColumn("prediction", F.lit(0))
    return distance.adjusted_rand(found, label, "prediction").select(F.lit(k).alias("k"), "ari")


def cross_validated(v: DataFrame, label: str = "class", key: str = "sample_id", folds: int = 5, seed: int = 42) -> DataFrame:
    """(fold, n, accuracy) of multinomial regression on vectors (key, values, label): folds by hash within each class, each held out once. Labels may be of any type."""
    names = v.select(label).distinct().orderBy(label)
    code = F.create_map(*[F.lit(x) for k, r in enumerate(names.collect()) for x in (r[0], float(k))])
    d = v.select(key, code[F.col(label)].alias("label"), array_to_vector(F.col("values").cast("array<double>")).alias("features"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int").alias("fold"))
    one = lambda k: LogisticRegression(family="multinomial", maxIter=50).fit(d.where(F.col("fold") != k)).transform(d.where(F.col("fold") == k))
    out = reduce(DataFrame.unionByName, [one(k).select("fold", "label", "prediction") for k in range(folds)])
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("accuracy"))
