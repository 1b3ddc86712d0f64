import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.functions import special, text
from verdure.operators import distance, enrich, matrix, models, ranks, tables
from verdure.sources import readers, sinks


def long(spark, x, classes=None):
    rows = [(f"g{i:03d}", f"s{j:02d}", float(x[i, j]), None if classes is None else classes[j]) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "gene_id string, sample_id string, value double, class string")


def wide(df, x):
    out = np.full(x.shape, np.nan)
    for r in df.collect():
        out[int(r.gene_id[1:]), int(r.sample_id[1:])] = r.value
    return out


def test_special_functions():
    assert np.allclose(special.digamma([1, 0.5, 10]), [-0.5772156649, -1.9635100260, 2.2517525891])
    assert np.allclose(special.trigamma([1, 2.5]), [math.pi**2 / 6, 0.4903577561])
    assert abs(special.trigamma_inverse(float(special.trigamma(3.7))) - 3.7) < 1e-6
    assert np.allclose(special.t_two_sided([2.0, 0.0, -12.7062], [10, 5, 1]), [0.0733880, 1, 0.05], atol=1e-5)
    assert np.allclose(special.hypergeom_tail([2, 0, 5], [10, 10, 10], [4, 4, 4], [3, 3, 3]), [1 / 3, 1, 0])


def reference_rank_in(x, classes, bins, k):
    r = np.empty_like(x)
    for j in range(x.shape[1]):
        v = x[:, j]
        pct = np.array([((v < a).sum() + ((v == a).sum() + 1) / 2) / len(v) for a in v])
        r[:, j] = np.ceil(pct * bins)
    w = np.empty_like(r)
    for j in range(x.shape[1]):
        p = np.polyfit(r[:, j], x[:, j], 2)
        w[:, j] = r[:, j] * (2 * p[0] * r[:, j] + p[1])
    v = w.copy()
    for c in set(classes):
        m = np.array(classes) == c
        v[:, m] -= v[:, m].mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(v, full_matrices=False)
    return w - u[:, :k] @ np.diag(s[:k]) @ vt[:k]


def test_rank_in_against_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, (40, 12)) + np.repeat([0, 3], 6)[None, :]
    classes = ["a", "b"] * 6
    m = long(spark, x, classes)
    assert np.allclose(wide(models.rank_in(m, 20, k=2), x), reference_rank_in(x, classes, 20, 2), atol=1e-6)
    auto, again = wide(models.rank_in(m), x), wide(models.rank_in(m), x)
    assert np.isfinite(auto).all() and np.allclose(auto, again)
    assert np.isfinite(wide(models.rank_in(m, k=9999), x)).all()
    assert not np.allclose(wide(models.rank_in(m, 50, k=1), x), wide(models.rank_in(m, 100, k=1), x))


def test_rank_in_refuses_bad_classes(spark):
    x = np.random.default_rng(0).normal(size=(5, 4))
    with pytest.raises(ValueError):
        models.rank_in(long(spark, x, ["a"] * 4))
    with pytest.raises(ValueError):
        models.rank_in(long(spark, x, ["a", "b", None, "a"]))


def test_rank_in_flat_sample_keeps_shape(spark):
    x = np.random.default_rng(2).normal(5, 1, (30, 6))
    x[:, 2] = 5.0
    out = wide(models.rank_in(long(spark, x, list("aabbab")), k=1), x)
    assert np.isfinite(out).all()


def test_combat_removes_batch_shift_and_keeps_covariates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, 1, (60, 20)) + rng.normal(0, 1, (60, 1))
    batch = ["b0"] * 10 + ["b1"] * 10
    group = ["u", "v"] * 10
    y = x + np.array([0.0] * 10 + [4.0] * 10) + np.array([0.0, 2.0] * 10)
    y[7] = 3.0
    m = long(spark, y)
    s = spark.createDataFrame([(f"s{j:02d}", batch[j], group[j], "one") for j in range(20)], "sample_id string, study_id string, tissue string, flat string")
    out = wide(models.combat(m, s, covariates=("tissue", "flat"), genes_a_group=16), y)
    assert (np.abs(out[:, :10].mean(axis=1) - out[:, 10:].mean(axis=1)) < 0.6).all() and np.allclose(out[7], 3.0)
    assert abs((out[:, 1::2] - out[:, ::2]).mean() - 2.0) < 0.2
    with pytest.raises(ValueError):
        models.combat(m, s.withColumn("study_id", F.when(F.col("sample_id") == "s00", "alone").otherwise("rest")))


def test_moderated_t_shrinks_and_bh_is_monotone(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (80, 10))
    x[:5, :5] += 4
    m = long(spark, x).withColumn("treated", F.col("sample_id") < "s05")
    fit = models.two_groups(m)
    out = {r.gene_id: r for r in models.moderated(fit).collect()}
    assert sorted(out, key=lambda g: out[g].p)[:4] and {f"g{k:03d}" for k in range(5)} >= set(sorted(out, key=lambda g: out[g].p)[:4])
    rows = sorted(out.values(), key=lambda r: r.p)
    q = [min(min(r.p * len(rows) / (k + 1) for k, r in list(enumerate(rows))[i:]), 1) for i in range(len(rows))]
    assert np.allclose([r.adj_p for r in rows], q)


def test_running_sum_signs_and_repeats(spark):
    ranked = spark.createDataFrame([(f"g{k}", float(10 - k)) for k in range(21)], "gene_id string, score double")
    sets = spark.createDataFrame([("up", f"g{k}") for k in range(4)] + [("down", f"g{k}") for k in range(17, 21)] + [("none", "zz")], "term string, gene_id string")
    a, b = ([tuple(r) for r in enrich.running_sum(ranked, sets, permutations=50).orderBy("term").collect()] for _ in range(2))
    es = {r[0]: r[2] for r in a}
    assert a == b and es["up"] == 1.0 and es["down"] == -1.0 and es["none"] is None


def test_closure_of_a_diamond(spark):
    e = spark.createDataFrame([("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")], "child string, parent string")
    got = {tuple(r) for r in enrich.closure(e).collect()}
    assert got == {(x, x) for x in "abcd"} | {("d", "b"), ("d", "c"), ("d", "a"), ("b", "a"), ("c", "a")}
    ann = spark.createDataFrame([("g", "d"), ("h", "z")], "gene_id string, go_id string")
    assert {tuple(r) for r in enrich.propagate(ann, enrich.closure(e)).collect()} == {("g", x) for x in "abcd"} | {("h", "z")}


def test_guard_and_filters(spark):
    m = spark.createDataFrame([("a", "s", 25.0)], "gene_id string, sample_id string, value double")
    with pytest.raises(Exception, match="above range"):
        matrix.guard_range(m).collect()
    m = spark.createDataFrame([("a", "s", 1.0), ("a", "t", 0.0), ("b", "s", 2.0), ("b", "t", float("nan"))], "gene_id string, sample_id string, value double")
    assert {r.missing_pct for r in matrix.missing_share(m).collect()} == {50.0} and matrix.filter_matrix(m, 40).count() == 0
    assert ranks.percent_rank_average(m.where("sample_id = 't'")).where("gene_id = 'b'").first().pct is None


def test_intervals_and_pairs(spark):
    i = spark.createDataFrame([("g", 0, 10), ("g", 2, 5), ("g", 10, 12), ("g", 20, 21)], "gene_id string, start long, end long")
    assert ranks.union_length(i, "gene_id").first().length == 13
    v = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(30)], "sample_id long, values array<double>")
    p = distance.pair_distances(v).collect()
    assert len(p) == 435 and all(r.a < r.b and r.distance == r.b - r.a for r in p)


def test_cramers_v_of_a_square(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("b", "y")] * 10, "p string, q string")
    assert abs(distance.cramers_v(df, "p", "q").first().v - 0.9) < 1e-9 and distance.cramers_v(df.where("p = 'a'"), "p", "q").first().v == 0


def test_text_expressions(spark):
    df = spark.createDataFrame([("x_at1g01010.2", "1a b-c", " [ 'leaf tip' ] ", 8040, "single-cell and CAGE")], "a string, b string, c string, s long, d string")
    row = df.select(text.locus(F.col("a")), text.make_names(F.col("b")), text.clean_term(F.col("c")), text.duration(F.col("s")), text.flags(F.col("d"), ["cage", "cag"])).first()
    assert list(row) == ["AT1G01010", "X1a.b.c", "Leaf Tip", "2h 14m", ["cage"]]


def test_readers_and_sinks(spark, tmp_path):
    w = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    m = readers.wide_csv(spark, w("m.csv", 'gene,"s1",s2.1\nAT1G01010,1.5,x\nAT1G01020,,2\n'))
    assert sorted(map(tuple, m.collect()), key=repr) == sorted([("AT1G01010", "s1", 1.5), ("AT1G01010", "s2", None), ("AT1G01020", "s1", None), ("AT1G01020", "s2", 2.0)], key=repr)
    t = readers.salmon_tsv(spark, w("t.tsv", "gene_id\tgene_name\tr1\nx.at1g01010\tn\t3\nnone\tn\t4\n")).collect()
    assert [tuple(r) for r in t] == [("AT1G01010", "r1", 3.0)]
    c = readers.sniffed_counts(spark, w("c.txt", "# by hand\ng\ta\tb\n" + "".join(f"g{k}\t{k}\t{k + 1}\n" for k in range(120)) + "__no_feature\t9\t9\n"))
    assert c.count() == 240
    with pytest.raises(ValueError):
        readers.sniffed_counts(spark, w("s.txt", "g\ta\nx\t1\n"))
    terms, edges = readers.obo(spark, w("o.obo", "format-version: 1.2\n\n[Term]\nid: GO:1\nname: one\nnamespace: p\n\n[Term]\nid: GO:2\nname: two\nnamespace: p\nis_a: GO:1 ! one\n\n[Term]\nid: GO:3\nname: old\nis_obsolete: true\n"))
    assert terms.count() == 2 and [tuple(r) for r in edges.collect()] == [("GO:2", "GO:1")]
    g = readers.gtf_exons(spark, w("g.gtf", '#x\n1\ts\texon\t11\t20\t.\t+\t.\tgene_id "G1"; x "y"\n1\ts\tgene\t1\t20\t.\t+\t.\tgene_id "G1"\n'))
    assert [tuple(r) for r in g.collect()] == [("G1", 10, 20)]
    assert [r.id for r in readers.id_list(spark, w("i.txt", "b,a\nb\nc,\n")).orderBy("pos").collect()] == ["b", "a", "c"]
    w("l.json", '{"gsm1": {"tissue": ["leaf", "root"], "treatment": [{"val": "Heat", "intensity": 2}]}, "gsm2": {"tissue": "stem"}}')
    w("l2.json", '[{"id": "gsm3", "tissue": ["seed"]}]')
    w("l3.json", "{broken")
    lab = readers.label_documents(spark, str(tmp_path / "l*.json"))
    assert {tuple(r)[1:] for r in lab.collect()} == {("GSM1", "tissue", "leaf", None), ("GSM1", "tissue", "root", None), ("GSM1", "treatment", "Heat", 2), ("GSM2", "tissue", "stem", None), ("GSM3", "tissue", "seed", None)}
    x = spark.createDataFrame([("s", ["Age: 3 d", "plain"])], "sample_id string, characteristics array<string>")
    assert {tuple(r) for r in sinks.characteristics(x).collect()} == {("s", "age", "3 d"), ("s", "characteristic_1", "plain")}
    sinks.write_demultiplexed(m, spark.createDataFrame([("s1", "A"), ("s2", "B")], "sample_id string, study_id string"), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("study_id = 'A'").count() == 2
    sheet, gone = sinks.samplesheet_without(spark.createDataFrame([("a",), ("b",)], "sample string"), spark.createDataFrame([("b",)], "sample string"))
    assert gone == 1 and sheet.count() == 1
    up = tables.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "a"), (2, "c")}


def test_closure_of_long_chains_and_many_paths(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(150)]
    diamonds = [(f"d{k}", f"{s}{k}") for k in range(20) for s in "lr"] + [(f"{s}{k}", f"d{k + 1}") for k in range(20) for s in "lr"]
    got = enrich.closure(spark.createDataFrame(chain + diamonds, "child string, parent string")).groupBy("node").count()
    n = dict(map(tuple, got.collect()))
    assert n["c0"] == 151 and n["c150"] == 1 and n["d0"] == 61
    loop = enrich.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
    assert loop.count() == 4 and enrich.closure(spark.createDataFrame([], "child string, parent string")).count() == 0


@pytest.mark.parametrize("k_max", [2, 3, 10])
def test_rank_in_finds_k_among_the_values_it_may_use(spark, k_max):
    rng = np.random.default_rng(11)
    x = rng.normal(5, 2, (40, 12)) + np.outer(rng.normal(size=40), rng.normal(size=12)) * 3
    classes = ["a", "b"] * 6
    s = np.linalg.svd(_left(x, classes, 100), compute_uv=False)[: min(k_max, 11)]
    k = int(np.argmax(s[:-1] / s[1:])) + 1
    assert np.allclose(wide(models.rank_in(long(spark, x, classes), k_max=k_max), x), reference_rank_in(x, classes, 100, k), atol=1e-6)


def _left(x, classes, bins):
    full = reference_rank_in(x, classes, bins, 0)
    out = full.copy()
    for c in set(classes):
        m = np.array(classes) == c
        out[:, m] -= out[:, m].mean(axis=1, keepdims=True)
    return out


def test_adjusted_p_without_groups(spark):
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(size=300) ** 3, np.repeat(0.2, 40), np.repeat(1.0, 60)])
    rows = [(k, float(v)) for k, v in enumerate(p)] + [(9999, None)]
    got = dict(map(tuple, models.adjust_bh(spark.createDataFrame(rows, "k int, p double").repartition(3)).select("k", "adj_p").collect()))
    order = np.argsort(p)
    q = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / (np.arange(len(p)) + 1))[::-1])[::-1])
    assert got[9999] is None and np.allclose([got[k] for k in order], q)
    assert models.adjust_bh(spark.createDataFrame([], "k int, p double")).count() == 0


def test_average_ranks_over_a_table(spark):
    v = np.random.default_rng(2).integers(0, 30, 200).astype(float)
    got = dict(map(tuple, ranks.average_rank(spark.createDataFrame([*enumerate(map(float, v)), (999, None)], "k int, v double"), "v").select("k", "rank").collect()))
    assert got[999] is None and all(got[k] == (v < x).sum() + ((v == x).sum() + 1) / 2 for k, x in enumerate(v))


def test_statuses_of_trackers(spark, tmp_path):
    for name, said in {"GSE1.txt": "0", "GSE2.txt": " 2\n", "GSE3.txt": "3", "GSE4.txt": "ignore", "GSE5.txt": "what", "GSE6.txt": "9", "GSE7.txt": "5", "GSE1_missing_samples.txt": "s", "GSE1_ecotype.txt": "ler", "other.txt": "1"}.items():
        (tmp_path / name).write_text(said)
    got = {r.study_id: r.state for r in readers.tracker_statuses(spark, str(tmp_path / "*")).collect()}
    assert got == {"GSE1": "not_tried", "GSE2": "processed", "GSE3": "ignore", "GSE4": "ignore", "GSE5": "unknown", "GSE6": "unknown", "GSE7": "semi_processed"}


def test_strongest_partners_of_a_block_hold_the_strongest_of_all(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 9))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(9)], "gene_id int, sample_id int, value double")
    r = np.corrcoef(x)
    np.fill_diagonal(r, 0)
    want = {(i, int(j)) for i in range(60) for j in sorted(range(60), key=lambda j: (-abs(round(r[i, j], 9)), j))[:4] if abs(r[i, j]) >= 0.3}
    got = {(e.src, e.dst) for e in distance.coexpression(m, 4, 0.3).where("src <> dst").collect()}
    assert got == want


def test_a_repeated_key_is_filled_with_the_least_value(spark):
    look = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", None)], "k string, v string")
    got = {tuple(r) for r in tables.backfill(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), look, "k", "v", "none").collect()}
    assert got == {("a", "x"), ("b", "none"), ("c", "none")}


def test_vector_pairs_from_large_blocks(spark, monkeypatch):
    """Rows of pairs go out a strip at a time: blocks don't become more with the rows up to WIDE, so a vector is sent to no more of them; each pair is there once, with string keys too."""
    import numpy as np

    from verdure.operators import distance, pair_folds

    monkeypatch.setattr(distance, "BLOCK_ROWS", 4)
    monkeypatch.setattr(pair_folds, "STRIP", 64)
    blocks = []
    real = pair_folds.folded
    monkeypatch.setattr(pair_folds, "folded", lambda *a, **k: blocks.append(a[6]) or real(*a, **k))
    x = np.random.default_rng(6).normal(size=(100, 4))
    v = spark.createDataFrame([(f"s{i:03}", x[i].tolist()) for i in range(100)], "sample_id string, values array<double>")
    for kind, want in (("distance", np.sqrt(((x[:, None] - x) ** 2).sum(2))), ("dot", x @ x.T)):
        got = {(r.a, r.b): r.value for r in distance.vector_pairs(v, kind).collect()}
        assert len(got) == 4950 and all(abs(got[f"s{i:03}", f"s{j:03}"] - want[i, j]) < 1e-12 for i in range(100) for j in range(i + 1, 100))
        some = {(r.a, r.b) for r in distance.vector_pairs(v, kind, least=1.5).collect()}
        assert some == {k for k, d in got.items() if abs(d) >= 1.5}
    assert blocks == [distance.WIDE] * 4
