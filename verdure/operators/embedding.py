"""Sample embeddings: expression laid out in the order of a gene vocabulary, a model over batches of samples, the mean over genes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a gene that a sample has no value of.
PAD = -10.0
#: Numbers of a model's weights: they go to every worker.
WEIGHTS = 1 << 25
#: Numbers a batch may take between the layers.
STEP = 1 << 22


def in_order(m: DataFrame, vocabulary: DataFrame, pad: float = PAD) -> DataFrame:
    """(sample_id, values): each sample's values by `pos` of the vocabulary (gene_id, pos from 0, none left out), the mean where a gene comes twice.

    pad stands where there is no value or a null. Genes outside the vocabulary are left out; a sample with none of its genes is all pad. A null sample is left out.
    """
    n = vocabulary.count()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def laid(pos: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([_mean_at(p, v, n, pad) for p, v in zip(pos, value, strict=True)])

    met = m.where("sample_id IS NOT NULL").join(vocabulary.select("gene_id", "pos"), "gene_id", "left")
    cell = F.when(F.col("pos").isNotNull() & F.col("value").isNotNull(), F.struct(F.col("pos").cast("int").alias("p"), F.col("value").cast("double").alias("v")))
    return met.groupBy("sample_id").agg(F.collect_list(cell).alias("c")).select("sample_id", laid(F.col("c.p"), F.col("c.v")).alias("values"))


def _mean_at(pos, value, n: int, pad: float) -> np.ndarray:
    pos, value = np.asarray(pos, np.int64), np.asarray(value, float)
    times = np.bincount(pos, minlength=n)
    return np.where(times > 0, np.bincount(pos, value, n) / np.maximum(times, 1), pad)


def embed(m: DataFrame, vocabulary: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], pad: float = PAD, batch: int = 64) -> DataFrame:
    """(sample_id, embedding): make_model() is called once a worker and gives a function from (samples, genes) to (samples, width)."""
    values = in_order(m, vocabulary, pad)
    n = vocabulary.count()
    model = predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[n]])
    return values.select("sample_id", model("values").alias("embedding")) if n else values.select("sample_id", F.array().cast("array<double>").alias("embedding"))


def gene_layer(weights: DataFrame) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A model of one layer a gene: the mean over genes of max(0, x w + b), of weights (pos, w, b), w and b arrays of one width. More than WEIGHTS numbers are refused."""
    size = weights.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("w")), F.lit(0)).alias("k")).first()
    if 2 * size.n * size.k > WEIGHTS:
        raise ValueError(f"{2 * size.n * size.k} weights are more than {WEIGHTS}")
    at = weights.select("pos", "w", "b").toPandas().sort_values("pos")
    shared = weights.sparkSession.sparkContext.broadcast(tuple(np.array(at[c].tolist(), float) for c in ("w", "b")))

    def make():
        w, b = shared.value
        return lambda x: mean_over_genes(x, w, b)

    return make


def mean_over_genes(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Genes a slice at a time, so that samples x genes x width is never held whole."""
    x, out = np.asarray(x, float), np.zeros((len(x), w.shape[1]))
    step = max(1, STEP // max(1, out.size))
    for low in range(0, len(w), step):
        s = slice(low, low + step)
        out += np.maximum(x[:, s, None] * w[s] + b[s], 0).sum(axis=1)
    return out / max(1, len(w))
