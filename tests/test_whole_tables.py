"""Queries over whole tables that have no SQL, against brute force on the smallest tables."""

import numpy as np
import pyarrow.parquet as pq

from verdure import plans

SF = "/root/testdata/sf0.001"


def rows(name, *cols):
    return list(zip(*(pq.read_table(f"{SF}/{name}.parquet").column(c).to_pylist() for c in cols), strict=True))


def test_jaccard_of_whole_texts(spark):
    d = {i: set(t.split(" ")) for i, t in rows("documents", "doc_id", "text")}
    want = {(i, i + 1): round(len(d[i] & d[i + 1]) / len(d[i] | d[i + 1]), 9) for i in d if i + 1 in d}
    got = {(x.a, x.b): x.jaccard for x in plans.QUERIES["set_jaccard_whole"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)


def test_spearman_of_all_samples(spark):
    from verdure.plans.matrix_queries import dense

    cells = dense(spark, SF).select("sample_id", "gene_id", "value").collect()
    by = {}
    for c in cells:
        by.setdefault(c.sample_id, {})[c.gene_id] = c.value

    def ranked(v):
        v = np.array([v[g] for g in sorted(v)])
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    ids = sorted(by)
    want = np.corrcoef([ranked(by[i]) for i in ids])
    got = plans.QUERIES["sample_spearman_all"](spark, SF).collect()
    at = {i: k for k, i in enumerate(ids)}
    assert len(got) == len(ids) * (len(ids) - 1) // 2 > 1770
    assert all(abs(x.rho - want[at[x.a], at[x.b]]) < 2e-6 for x in got)


def test_similarity_of_all_labels(spark):
    p = sorted(rows("part", "p_partkey", "p_type", "p_brand"))
    want = {(a, b): round((2 * (t == u) + (c == d)) / 3, 8) for a, t, c in p for b, u, d in p if a < b and (t == u or c == d)}
    assert {(x.a, x.b): x.similarity for x in plans.QUERIES["label_similarity_all"](spark, SF).collect()} == want


def test_axes_treatments_and_intensity(spark):
    from verdure.operators.distance import label_similarity

    w = {"tissue": 2.0, "treatment": 1.0, "treatment_intensity": 1.0}
    cases = [
        (("leaf", "Heat+Salt", "2"), ("leaf", "heat", "4"), (2 + 0.5 + 0.25) / 4),
        (("leaf", "Heat", "mild"), ("root", "Heat", "4"), (0 + 1 + 1) / 4),
        (("leaf", "Heat", "0"), ("leaf", "Heat", "0"), 1.0),
        (("leaf", "Heat", "1"), ("leaf", "Salt", "1"), 2 / 4),
        ((" leaf", None, None), ("leaf", "Heat", "3"), 1.0),
        (("Unknown", None, "na"), ("leaf", "Heat", "3"), 0.0),
    ]
    s = "struct<tissue:string,treatment:string,treatment_intensity:string>"
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], f"k int, a {s}, b {s}").select("k", label_similarity("a", "b", w).alias("s")).collect()
    assert all(abs(x.s - cases[x.k][2]) < 1e-12 for x in got)


def test_proxies_of_all_roots(spark):
    p = rows("part", "p_partkey", "p_size", "p_retailprice")
    best = {}
    for k, size, price in p:
        up = k
        while size > 16:
            best[up] = min(best.get(up, (True, 9e9, 0)), (k != up, price / 10000, k))
            if not up:
                break
            up //= 2
    got = {x.root: (x.proxy, x.go_id) for x in plans.QUERIES["term_proxy_all"](spark, SF).collect()}
    assert got == {k: (v[0], v[2]) for k, v in best.items() if k in {x[0] for x in p}} and len(got) > 40
