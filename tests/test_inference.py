"""Distance evaluation, embeddings and the matrix source against plain numpy and Python."""

import gzip
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import distance, embedding
from verdure.sources import wide_matrix


def ranks(x):
    x = np.asarray(x, float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def two_sided(r, n):
    """P(|T| >= t) by summing the density of t in small steps."""
    df = n - 2
    t = abs(r) * math.sqrt(df / (1 - r * r))
    u = np.linspace(0, math.atan(t / math.sqrt(df)), 200_001)
    f = np.cos(u) ** (df - 1)
    inside = ((f[1:] + f[:-1]) / 2).sum() * (u[1] - u[0]) / math.sqrt(math.pi) * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2))
    return 1 - 2 * inside


def test_evaluation_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    study = [0, 0, 0, 1, 1, 2, 3, 3]
    rows = [(i, j, float(rng.gamma(2)), round(float(rng.random()), 1)) for i, j in itertools.combinations(range(8), 2)]
    df = spark.createDataFrame([*rows, (0, 9, None, 0.5), (1, 9, 1.0, None)], "a int, b int, distance double, similarity double")
    of = F.array(*[F.lit(s) for s in study])
    got = distance.evaluation(df, F.get(of, F.col("a")) == F.get(of, F.col("b"))).first()
    d, s = (np.array([x[k] for x in rows]) for k in (2, 3))
    bar = d.mean()
    pools = {}
    for i, j, x, y in rows:
        for k in (i, j):
            pools.setdefault((k, study[i] == study[j]), []).append(x * y)
    for name, own in (("g_inter", False), ("g_intra", True)):
        assert math.isclose(got[name], sum(np.mean(v) for (_, o), v in pools.items() if o == own) / 8 / bar, rel_tol=1e-9)
    assert math.isclose(got.dist_bar, bar) and math.isclose(got.separation, (d * s).sum() / (d * (1 - s)).sum())
    p, q = np.corrcoef(d, s)[0, 1], np.corrcoef(ranks(d), ranks(s))[0, 1]
    assert math.isclose(got.pearson, p) and math.isclose(got.spearman, q)
    assert math.isclose(got.pearson_p, two_sided(p, 28), rel_tol=1e-6) and math.isclose(got.spearman_p, two_sided(q, 28), rel_tol=1e-6)
    assert (got.n_pairs, got.n_samples, got.n_alone) == (28, 8, 1)


@pytest.mark.parametrize(("rows", "n"), [([], 0), ([(1, 2, 1.0, 1.0)], 1), ([(1, 2, 1.0, 0.5), (1, 3, 1.0, 0.5), (2, 3, 1.0, 0.5)], 3), ([(1, 2, 0.0, 0.0), (1, 3, 0.0, 1.0)], 2)])
def test_evaluation_of_few_or_still_pairs(spark, rows, n):
    got = distance.evaluation(spark.createDataFrame(rows, "a int, b int, distance double, similarity double"), F.lit(None).cast("boolean")).first()
    assert got.n_pairs == n and got.pearson_p is None and got.spearman_p is None and got.g_intra is None
    assert (got.g_inter is None) == (n in (0, 2)) and got.n_alone == got.n_samples


def test_embedding_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x, w, b = rng.normal(size=(150, 9)), rng.normal(size=(11, 4)), rng.normal(size=(11, 4))
    cells = [(f"g{g}", f"s{i}", float(x[i, g])) for i in range(150) for g in range(9)]
    extra = [("g0", "s0", 5.0), ("g1", "s1", None), ("outside", "lonely", 1.0), ("g2", None, 1.0)]
    m = spark.createDataFrame(cells + extra, "gene_id string, sample_id string, value double")
    vocabulary = spark.createDataFrame([(f"g{g}", 10 - g) for g in range(11)], "gene_id string, pos int")
    weights = spark.createDataFrame([(k, [float(v) for v in w[k]], [float(v) for v in b[k]]) for k in range(11)], "pos int, w array<double>, b array<double>")
    want = np.full((151, 11), -10.0)
    want[:150, 2:] = x[:, ::-1]
    want[0, 10] = (x[0, 0] + 5) / 2
    got = {r.sample_id: r["values"] for r in embedding.in_order(m, vocabulary).collect()}
    names = [f"s{i}" for i in range(150)] + ["lonely"]
    assert got.keys() == set(names) and np.allclose([got[k] for k in names], want)
    out = {r.sample_id: r.embedding for r in embedding.embed(m, vocabulary, embedding.gene_layer(weights), batch=7).collect()}
    assert np.allclose([out[k] for k in names], np.maximum(want[:, :, None] * w + b, 0).mean(axis=1))


def test_embedding_refuses_large_weights_and_takes_empty_tables(spark, monkeypatch):
    weights = spark.createDataFrame([(0, [1.0], [0.0])], "pos int, w array<double>, b array<double>")
    none = spark.createDataFrame([], "gene_id string, sample_id string, value double")
    vocabulary = spark.createDataFrame([("g", 0)], "gene_id string, pos int")
    assert embedding.embed(none, vocabulary, embedding.gene_layer(weights)).count() == 0
    one = spark.createDataFrame([("g", "s", 1.0)], none.schema)
    assert embedding.embed(one, vocabulary.where("false"), embedding.gene_layer(weights)).first().embedding == []
    monkeypatch.setattr(embedding, "WEIGHTS", 1)
    with pytest.raises(ValueError, match="more than"):
        embedding.gene_layer(weights)


def test_slices_of_genes_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(3, 20)), rng.normal(size=(20, 2)), rng.normal(size=(20, 2))
    whole = embedding.mean_over_genes(x, w, b)
    monkeypatch.setattr(embedding, "STEP", 12)
    assert np.allclose(embedding.mean_over_genes(x, w, b), whole)


@pytest.fixture
def matrices(tmp_path):
    """Two plain files and a packed one, with other headers, quotes, gaps and no line end at the close."""
    want = []

    def text(samples, genes, seed):
        rng = np.random.default_rng(seed)
        out = ["gene,note," + ",".join(samples)]
        for g in genes:
            values = [round(float(v), 3) for v in rng.normal(size=len(samples))]
            want.extend((g, s.strip('"').split(".")[0], v) for s, v in zip(samples, values, strict=True))
            out.append(f'{g},"a, b",' + ",".join(map(str, values)))
        return "\n".join(out)

    (tmp_path / "a.csv").write_text(text([f"S{k}.CEL" for k in range(40)], [f"g{k}" for k in range(300)], 1))
    (tmp_path / "b.csv").write_text(text(["S90", '"S7"', "S91"], ["g1", "h1"], 2) + "\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(text(["Z1", "S3"], [f"z{k}" for k in range(50)], 3))
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "empty.csv").write_text("")
    return str(tmp_path), sorted(want)


@pytest.mark.parametrize("size", [1 << 20, 977, 61])
def test_matrix_files_by_ranges(spark, matrices, size):
    path, want = matrices
    df = wide_matrix.scan(spark, path, drop=("note",), range_bytes=size)
    assert sorted(tuple(r) for r in df.coalesce(8).collect()) == want


def test_matrix_samples_named_pushed_and_sampled(spark, matrices):
    path, want = matrices
    few = [x for x in want if x[1] in ("S7", "S3", "Z1")]
    assert sorted(map(tuple, wide_matrix.scan(spark, [path], drop=("note",), samples=["S7", "S3", "Z1", "none"]).collect())) == few
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = wide_matrix.scan(spark, path, drop=("note",)).where("sample_id IN ('S7', 'S3', 'Z1') AND value > 0")
        assert sorted(map(tuple, df.collect())) == [x for x in few if x[2] > 0]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "sample_id" not in plan.split("Filter", 1)[1].split("\n")[0] if "Filter" in plan else True
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    got = wide_matrix.sampled(spark, path, 4, seed=2, drop=("note",))
    names = {r[0] for r in got.select("sample_id").distinct().collect()}
    assert len(names) == 4 and sorted(map(tuple, got.collect())) == [x for x in want if x[1] in names]


def test_only_wanted_columns_are_parsed():
    body = b"g," + b",".join(b"%d" % k for k in range(500)) + b"\nh," + b",".join([b"oops", b"NA", b" 2.5 "] + [b"1"] * 497) + b"\n"
    t = wide_matrix.parsed(body, 501, ",", 0, [1, 2, 3])
    assert t.num_columns == 4 and t.column(1).to_pylist() == [0.0, None] and t.column(2).to_pylist() == [1.0, None] and t.column(3).to_pylist() == [2.0, 2.5]


def test_matrix_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gene,s1\nx,1\n")
    (tmp_path / "short.csv").write_text("gene,s1,s2\nx,1\n")
    (tmp_path / "head.csv").write_text("gene,s1\n")
    assert wide_matrix.scan(spark, str(tmp_path / "head.csv")).count() == 0
    for path, gene in ((tmp_path / "a.csv", "absent"), (tmp_path / "short.csv", None), (tmp_path / "none.csv", None)):
        with pytest.raises(Exception):  # noqa: B017
            wide_matrix.scan(spark, str(path), gene=gene).collect()
