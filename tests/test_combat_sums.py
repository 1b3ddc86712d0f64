"""ComBat without covariates: a gene's samples are never brought together in Python."""

import numpy as np
import pytest

from verdure.operators import models


def cells(spark, y):
    return spark.createDataFrame([(g, i, float(y[g, i])) for g in range(len(y)) for i in range(y.shape[1])], "gene_id int, sample_id int, value double")


def test_standardised_by_sums(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=(6, 12)) + 50
    batch = np.array([0] * 3 + [1] * 4 + [2] * 5)
    s = spark.createDataFrame([(i, int(b)) for i, b in enumerate(batch)], "sample_id int, study_id int")
    got = models.combat(cells(spark, y), s)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    fit = models._standardised_by_batch(cells(spark, y).join(s.withColumnRenamed("study_id", "_b"), "sample_id"), 12)
    of = np.array([y[:, batch == b].mean(1) for b in range(3)]).T[:, batch]
    sd = np.sqrt(((y - of) ** 2).mean(1))
    for r in fit.collect():
        assert r.z == pytest.approx((y[r.gene_id, r.sample_id] - y[r.gene_id].mean()) / sd[r.gene_id], rel=1e-9)
    assert got.count() == 72


def test_missing_cells_are_refused(spark):
    s = spark.createDataFrame([(i, i % 2) for i in range(4)], "sample_id int, study_id int")
    with pytest.raises(Exception, match="missing cells"):
        models.combat(cells(spark, np.arange(8.0).reshape(2, 4)).where("gene_id = 0 OR sample_id <> 3"), s).collect()
