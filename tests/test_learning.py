"""Components, clusters and regression of samples, report operators on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import distance, learning, reports


def test_components_against_svd(spark):
    x = np.random.default_rng(6).normal(0, 1, (25, 12)) * np.linspace(3, 0.3, 12) + 5
    m = spark.createDataFrame([(f"g{j:02d}", i, float(x[i, j])) for i in range(25) for j in range(12)], "gene_id string, sample_id long, value double")
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(12), np.argmax(np.abs(vt), axis=1)])[:, None]
    scores, share = learning.principal_components(m, k=4)
    got = np.array([r.scores for r in scores.orderBy("sample_id").collect()])
    assert np.allclose(got, c @ vt[:4].T, atol=1e-6) and np.allclose(share, s[:4] ** 2 / (s**2).sum(), rtol=1e-6)
    _, share = learning.principal_components(m, share=0.9)
    assert len(share) == int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.9)) + 1


def test_clusters_and_regression(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in rng.normal(8 * (k % 3), 1, 4) * np.array([1, 1, 0, 0])], "abc"[k % 3]) for k in range(120)]
    v = spark.createDataFrame(rows, "sample_id long, values array<double>, class string")
    a = learning.clusters_against(v).first()
    assert a.k == 3 and a.ari > 0.99 and learning.clusters_against(v, k=1).first().ari == 0
    cv = learning.cross_validated(v, folds=4).collect()
    assert {r.fold for r in cv} == {0, 1, 2, 3} and sum(r.n for r in cv) == 120 and min(r.accuracy for r in cv) > 0.95


def test_axis_weights_are_refused_without_metrics(spark):
    full = [("tissue", "multinomial_logistic_accuracy", 0.9), ("tissue", "KNN_Purity", 0.8), ("tissue", "Silhouette", -0.2), ("medium", "multinomial_logistic_accuracy", 0.5), ("medium", "KNN_Purity", 0.4), ("medium", "Silhouette", 0.3)]
    f = lambda rows: spark.createDataFrame(rows, "axis string, metric string, value double")
    got = {r.axis: r.weight for r in reports.axis_weights(f(full)).collect()}
    s = {"tissue": 0.05, "medium": (0.5 * 0.4 * 0.3) ** (1 / 3) + 0.05}
    p = {"tissue": 2.307, "medium": 0.217}
    w = {k: 0.5 * s[k] / (sum(s.values()) / 2) + 0.5 * p[k] / (sum(p.values()) / 2) for k in s}
    assert all(abs(got[k] - w[k] / (sum(w.values()) / 2)) < 1e-9 for k in w) and abs(sum(got.values()) - 2) < 1e-9
    for rows, why in ((full[:2] + full[3:5], "missing metrics"), (full[:5], "missing metric values"), ([("x", m, v) for _, m, v in full[:3]], "no axis")):
        with pytest.raises(ValueError, match=why):
            reports.axis_weights(f(rows))


def test_divergence_kinds(spark):
    item = "array<struct<val: string, intensity: int>>"
    side = lambda rows: spark.createDataFrame(rows, f"study_id string, sample_id string, axis string, items {item}")
    one = side([("s", "a", "treatment", [("Heat", 1)]), ("s", "b", "treatment", [("Heat", 1)]), ("s", "c", "treatment", [("Heat", 1), ("Salt", 2)]), ("s", "d", "tissue", [("Leaf", None), ("root", None)]), ("s", "e", "tissue", []), ("t", "f", "tissue", [("Leaf", None)]), ("s", "only", "tissue", [("x", None)])])
    two = side([("s", "a", "treatment", [("heat", 3)]), ("s", "b", "treatment", [("Cold", 1)]), ("s", "c", "treatment", [("Cold", 3)]), ("s", "d", "tissue", [("ROOT", None), ("leaf", None)]), ("s", "e", "tissue", [("root", None)]), ("t", "f", "medium", [("MS", None)])])
    d = reports.label_differences(one, two)
    assert {(r.sample_id, r.axis): r.kind for r in d.collect()} == {("a", "treatment"): "intensity_only", ("b", "treatment"): "val_only", ("c", "treatment"): "both_changed", ("f", "tissue"): "changed"}
    by = {r.study_id: (r.samples, r.diff_samples, dict(r.by_axis)) for r in reports.divergence_by_study(one, two, d).collect()}
    assert by == {"s": (5, 3, {"treatment": 3}), "t": (1, 1, {"tissue": 1})}


def test_terms_across_configurations(spark):
    up = spark.createDataFrame([("r", "r"), ("x", "r"), ("y", "r"), ("x", "x"), ("y", "y")], "node string, ancestor string")
    res = spark.createDataFrame([("combat", "r", 0.9, 1.0), ("combat", "x", 0.1, 2.0), ("filter", "x", 0.2, 3.0), ("filter", "y", 0.2, 4.0), ("other", "z", 0.1, 1.0)], "norm string, go_id string, fdr double, nes double")
    got = {r.norm: (r.go_id, r.proxy, r.nes, r.name) for r in reports.terms_across(res, up, spark.createDataFrame([("r",), ("q",)], "root string"), ("norm",)).collect()}
    assert got == {"combat": ("r", False, 1.0, "combat"), "filter": ("x", True, 3.0, "filter (proxy)")}
    pairs = reports.compared(res, ("go_id",), [("a", {"norm": "combat"}, {"norm": "filter"})], ("nes",)).collect()
    assert [tuple(r) for r in pairs] == [("a", "x", 2.0, 3.0)]


def test_screens_and_signed_edges(spark):
    s = spark.createDataFrame([("small RNA", None, None), ("a", "tRNA-derived and CAGE-seq", "x"), ("smallrna", "eclipse", "Non-coding RNA profiling"), (None, None, None)], "title string, summary string, type string")
    got = [(r.status.split()[0], r.matched) for r in reports.screened(s).collect()]
    assert got == [("FLAGGED", ["small rna"]), ("FLAGGED", ["trna-derived", "cage-seq", "cage"]), ("FLAGGED", ["non-coding"]), ("CLEAN", [])]
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", -2.0), ("b", "c", 0.0), ("c", "d", 3.0), ("a", "a", 9.0)], "src string, dst string, weight double")
    nodes, edges = distance.signed_ego(e, ["a"], 2)
    assert {r.node for r in nodes.collect()} == {"a", "b", "c"} and {tuple(r) for r in edges.collect()} == {("a", "b", -2.0, "negative"), ("b", "c", 0.0, "none")}
    v = reports.in_vocabulary(spark.createDataFrame([("s", "g1", 1.0), ("s", "zz", 5.0)], "sample_id string, gene_id string, value double"), spark.createDataFrame([("g2", 0), ("g1", 1)], "gene_id string, pos long"))
    assert v.first()["values"] == [0.0, 1.0] and reports.bands(spark.createDataFrame([(0, float(k)) for k in range(101)], "q int, value double")).select(F.round("low", 6), "median", F.round("high", 6)).first()[:] == (5.0, 50.0, 95.0)
