"""Ranges of large groups have one set of bounds, however often they are read."""

from verdure.operators import models


def test_bounds_are_worked_out_once(spark):
    """percentile_approx depends on the order in which parts are merged: a plan that holds it several times may number rows by different bounds."""
    df = spark.range(2000).selectExpr("id", "id % 2 AS g", "(id * 7919 % 2000) / 4000 AS p")
    got = models.adjust_bh(df, "p", ("g",), rows=100)
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g in (0, 1):
        ps = sorted((r.p, r.id) for r in df.collect() if r.g == g)
        least = 1.0
        for i in range(len(ps), 0, -1):
            least = min(least, ps[i - 1][0] * len(ps) / i)
            want[ps[i - 1][1]] = least
    assert {r.id: r.adj_p for r in got.collect()} == want
