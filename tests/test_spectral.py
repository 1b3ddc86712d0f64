"""Leading directions and Rank-In by them against numpy's SVD."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import spectral


def frame(spark, x):
    return spark.createDataFrame([(f"g{i:03d}", j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if not np.isnan(x[i, j])], "gene_id string, sample_id long, value double")


@pytest.mark.parametrize("k, width", [(3, None), (5, 2), (1, 1)])
def test_leading_directions(spark, k, width):
    x = np.random.default_rng(2).normal(0, 1, (80, 30)) * np.linspace(3, 0.2, 30)
    rows, names = spectral.wide_rows(frame(spark, x), "value")
    sv, u = spectral.directions(rows, len(names), k=k, width=width)
    _, want, vt = np.linalg.svd(x, full_matrices=False)
    assert names == list(range(30)) and np.allclose(sv, want[:k], rtol=1e-9)
    assert np.allclose(u @ u.T, vt[:k].T @ vt[:k], atol=1e-6)


def test_share_of_the_spread(spark):
    x = np.random.default_rng(3).normal(0, 1, (60, 20)) * np.linspace(4, 0.1, 20)
    rows, names = spectral.wide_rows(frame(spark, x), "value")
    _, want, _ = np.linalg.svd(x, full_matrices=False)
    for share in (0.5, 0.95, 1.0):
        sv, u = spectral.directions(rows, len(names), share=share, width=4)
        k = int(np.argmax(np.cumsum(want**2) / (want**2).sum() >= share - 1e-12)) + 1
        assert len(sv) == k and np.allclose(sv, want[:k], rtol=1e-6) and np.allclose(u.T @ u, np.eye(k), atol=1e-8)


def test_few_genes_and_zeros(spark):
    x = np.random.default_rng(4).normal(0, 1, (3, 12))
    rows, names = spectral.wide_rows(frame(spark, x), "value")
    sv, u = spectral.directions(rows, len(names), k=9)
    assert np.allclose(sv[:3], np.linalg.svd(x)[1]) and (sv[3:] < 1e-6).all()
    assert np.allclose(x @ u @ u.T, x)
    rows, names = spectral.wide_rows(frame(spark, np.zeros((4, 3))), "value")
    assert spectral.directions(rows, 3, share=0.95)[1].shape == (3, 0)


def test_rank_in_truncated(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(5, 2, (50, 14)) + np.repeat([0, 3], 7)[None, :]
    bins = np.empty_like(x)
    for j in range(14):
        bins[:, j] = np.ceil([((x[:, j] < a).sum() + ((x[:, j] == a).sum() + 1) / 2) / 50 * 20 for a in x[:, j]])
    mean = bins.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(bins - mean, full_matrices=False)
    k = int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.8)) + 1
    want = (u[:, :k] * s[:k]) @ vt[:k] + mean
    got = np.full(x.shape, np.nan)
    for r in spectral.rank_in_truncated(frame(spark, x), 20, 0.8).collect():
        got[int(r.gene_id[1:]), r.sample_id] = r.value
    assert 1 < k < 13 and np.allclose(got, want, atol=1e-6)
    x[4, 3] = x[9, 9] = np.nan
    some = spectral.rank_in_truncated(frame(spark, x))
    assert some.count() == 50 * 14 - 2 and some.where(F.col("value").isNull()).count() == 0
    flat = spectral.rank_in_truncated(frame(spark, np.ones((4, 3))))
    assert {r.value for r in flat.collect()} == {63.0}


def test_few_genes_of_many_samples(spark, monkeypatch):
    """The directions are those of the smaller side; the result is that of numpy either way."""
    x = np.random.default_rng(6).normal(5, 2, (9, 70)) + np.arange(9)[:, None]
    bins = np.empty_like(x)
    for j in range(70):
        bins[:, j] = np.ceil([((x[:, j] < a).sum() + ((x[:, j] == a).sum() + 1) / 2) / 9 * 20 for a in x[:, j]])
    mean = bins.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(bins - mean, full_matrices=False)
    k = int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.8)) + 1
    want, wide, plain = (u[:, :k] * s[:k]) @ vt[:k] + mean, [], spectral.directions
    monkeypatch.setattr(spectral, "directions", lambda rows, n, **kw: wide.append(n) or plain(rows, n, **kw))
    got = np.full(x.shape, np.nan)
    for r in spectral.rank_in_truncated(frame(spark, x), 20, 0.8).collect():
        got[int(r.gene_id[1:]), r.sample_id] = r.value
    assert wide == [9] and 1 < k < 9 and np.allclose(got, want, atol=1e-6)
