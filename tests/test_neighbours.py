"""Neighbours by blocks and by cells against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import neighbours


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (60, 6)) for c in rng.normal(0, 6, (5, 6))])
    x[200:260] = x[199]  # a crowd of equal ones
    label = np.repeat(list("abcde"), 60).astype(object)
    label[7] = "alone"
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]], str(label[i])) for i in range(len(x))], "sample_id long, values array<double>, class string")
    return x, label, df


def plain(x, queries, base, k):
    return {q: sorted((float(np.sqrt(((x[q] - x[b]) ** 2).sum())), b) for b in base)[:k] for q in queries}


@pytest.mark.parametrize("block", [40, 4096])
def test_exact_neighbours(spark, points, monkeypatch, block):
    x, _, df = points
    monkeypatch.setattr(neighbours, "BLOCK", block)
    base, queries = df.where("sample_id % 3 <> 0"), df.where("sample_id % 3 = 0")
    got = {}
    for r in neighbours.nearest(queries, base, 4).collect():
        got.setdefault(r.sample_id, []).append((r.rank, r.other, r.distance))
    want = plain(x, range(0, 300, 3), [i for i in range(300) if i % 3], 4)
    assert got.keys() == want.keys()
    for q, rows in got.items():
        rows = sorted(rows)
        assert [b for _, b, _ in rows] == [b for _, b in want[q]] and np.allclose([d for *_, d in rows], [d for d, _ in want[q]])


def test_index_with_a_crowd(spark, points, monkeypatch):
    _, _, df = points
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    index = neighbours.Index(df, cells=10)
    assert index.base.count() == 300 and index.base.groupBy("_c", "_p").count().agg(F.max("count")).first()[0] < 60
    exact = neighbours.nearest(df, df, 5)
    found = index.nearest(df, 5, probes=4)
    near = lambda d: d.groupBy("sample_id").agg(F.max("distance").alias("d"))
    worse = near(found).join(near(exact).withColumnRenamed("d", "e"), "sample_id").where("d > e + 1e-9").count()
    assert worse <= 30 and neighbours.recall(found, exact) >= 0.9 and neighbours.recall(index.nearest(df, 5, probes=10), exact) == 1.0


def test_probes_are_found_for_a_recall(spark, points):
    _, _, df = points
    index, exact = neighbours.Index(df.where("sample_id % 7 > 0"), cells=16), neighbours.nearest(df, df.where("sample_id % 7 > 0"), 3)
    p = index.probes_for(df.where("sample_id % 7 > 0"), 3, 0.9, 100)
    assert 1 <= p <= 16 and neighbours.recall(index.nearest(df, 3, p), exact) >= 0.85 and neighbours.recall(index.nearest(df, 3, 16), exact) == 1.0


def test_two_fold_purity(spark, points):
    x, label, df = points
    keep = [i for i in range(300) if label[i] != "alone"]
    got = {r.fold: (r.n, r.accuracy) for r in neighbours.two_fold_purity(df, F.col("sample_id") % 2, 5).collect()}
    for f in (0, 1):
        want = plain(x, [i for i in keep if i % 2 == f], [i for i in keep if i % 2 != f], 5)
        says = {q: min((-sum(label[b] == c for _, b in n), c) for c in {label[b] for _, b in n})[1] for q, n in want.items()}
        assert got[f] == (len(want), pytest.approx(np.mean([says[q] == label[q] for q in says])))
    by_index = {r.fold: r.accuracy for r in neighbours.two_fold_purity(df, F.col("sample_id") % 2, 5, probes=4).collect()}
    assert all(abs(by_index[f] - got[f][1]) < 0.05 for f in (0, 1))


def test_recall_asks_for_each_hundredth(spark):
    from verdure import plans

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").count()
    rows = plans.QUERIES["knn_index_recall"](spark, sf).collect()
    assert n and {r.n for r in rows} == {n} and {r["rank"] for r in rows} == {1, 2, 3, 4, 5} and rows[0].recall >= 0.9


@pytest.mark.parametrize("shift, scale", [(0, 1), (1e5, 1), (0, 1e25)])
def test_near_loses_none(monkeypatch, shift, scale):
    """Ruled out in single precision, by parts: the same as all distances in double precision, with crowds of equal vectors, far from 0 and beyond what single precision holds; what has no distance is left out."""
    monkeypatch.setattr(neighbours, "ROWS", 32)
    monkeypatch.setattr(neighbours, "COLUMNS", 64)
    rng = np.random.default_rng(2)
    x, y = (rng.normal(size=(n, 7)) * scale + shift for n in (90, 300))
    y[50:200], x[4] = y[3], y[3]
    y[9] = np.nan
    got = list(zip(*(c.tolist() for c in neighbours._near(x, y, 5)), strict=True))
    want = [(q, b, d) for q, r in plain(np.concatenate([x, y]), range(90), [i for i in range(90, 390) if i != 99], 5).items() for d, b in r]
    assert [(i, j + 90) for i, j, _ in got] == [(q, b) for q, b, _ in want] and np.allclose([d for *_, d in got], [d for *_, d in want], rtol=1e-12, atol=0)


def test_vectors_are_sent_to_few_blocks(spark, points, monkeypatch):
    """However many blocks of BLOCK there would be, a vector is sent no more often than for WIDE or about the root of the shuffle partitions."""
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    sent = []
    real = neighbours._merged
    monkeypatch.setattr(neighbours, "_merged", lambda q, b, *a: sent.append(q.count() + b.count()) or real(q, b, *a))
    exact = neighbours.nearest(points[2], points[2], 3)
    assert sent == [2 * 300 * 3] and exact.count() == 900
