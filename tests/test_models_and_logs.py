"""Linear models and set enrichment against numpy; logs and their stream against a plain reading."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.operators import gsea, linear, logs
from verdure.streaming import log_machine

# Linear models


def table(rng, n_genes=30, n_samples=24):
    target, tissue = rng.choice(["Control", "treatment"], n_samples), rng.choice(["leaf", "root", "stem"], n_samples, p=[0.6, 0.3, 0.1])
    y = rng.normal(5, 1, (n_genes, n_samples)) + (target == "treatment") * rng.normal(0, 1, (n_genes, 1)) + (tissue == "root") * 2.0
    y[rng.random(y.shape) < 0.2] = np.nan
    y[0, target == "treatment"] = np.nan  # nothing to compare
    y[1, 4:] = np.nan
    return target, tissue, y


def frames(spark, target, tissue, y):
    m = [(f"g{i:02d}", j, None if np.isnan(y[i, j]) and j % 2 else float(y[i, j])) for i in range(y.shape[0]) for j in range(y.shape[1])]
    s = [(j, str(a), str(b)) for j, (a, b) in enumerate(zip(target, tissue, strict=True))] + [(900, None, "leaf"), (901, "Control", None)]
    return spark.createDataFrame(m, "gene_id string, sample_id long, value double"), spark.createDataFrame(s, "sample_id long, target string, tissue string")


def least_squares(target, tissue, y):
    """(log_fc, s2, df, scale) by dense algebra, a gene at a time."""
    x = np.column_stack([target == "Control", target == "treatment", *(tissue == v for v in sorted(set(tissue))[1:])]).astype(float)
    c = np.zeros(x.shape[1])
    c[:2] = [-1, 1]
    ok = ~np.isnan(y)
    a, v = x[ok], y[ok]
    b = np.linalg.pinv(a) @ v
    df = len(v) - np.linalg.matrix_rank(a)
    can = np.allclose(c @ np.linalg.pinv(a) @ a, c, atol=1e-8)
    rest = float(((v - a @ b) ** 2).sum())
    return (float(c @ b) if can else None, rest / df if df > 0 else None, df, math.sqrt(c @ np.linalg.pinv(a.T @ a) @ c) if can else None)


def test_unbalanced_design_with_missing_cells(spark):
    target, tissue, y = table(np.random.default_rng(5))
    m, s = frames(spark, target, tissue, y)
    got = {r.gene_id: r for r in linear.linear_fit(m, s, ("target", "tissue"), linear.last_less_first("target")).collect()}
    assert len(got) == len(y)
    for i in range(len(y)):
        want, r = least_squares(target, tissue, y[i]), got[f"g{i:02d}"]
        for a, b in zip(want, (r.log_fc, r.s2, r.df, r.scale), strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-8), (i, want, r)
    assert got["g00"].log_fc is None and got["g01"].df <= 2


def test_moderated_results_keep_every_gene(spark):
    target, tissue, y = table(np.random.default_rng(6))
    m, s = frames(spark, target, tissue, y)
    rows = {r.gene_id: r for r in linear.differential(m, s).collect()}
    assert len(rows) == len(y) and rows["g00"].t is None and rows["g00"].adj_p is None
    ps = sorted(r.p for r in rows.values() if r.p is not None)
    for r in rows.values():
        if r.p is not None:
            assert abs(r.adj_p - min(1, min(q * len(ps) / (k + 1) for k, q in enumerate(ps) if q >= r.p))) < 1e-9 and (r.t > 0) == (r.log_fc > 0)
    one = s.withColumn("tissue", F.lit("leaf"))
    assert linear.differential(m, one).where("t IS NOT NULL").count() >= len(y) - 2
    with pytest.raises(ValueError, match="two levels"):
        linear.differential(m, s.withColumn("target", F.lit("a")))
    with pytest.raises(ValueError, match="no column"):
        linear.linear_fit(m, s, ("target",), {"targetnone": 1.0})


def test_intercept_and_many_cells(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(0, 1, (3, 40))
    batch = [f"b{k % 13}" for k in range(40)]
    m = spark.createDataFrame([(f"g{i}", j, float(y[i, j])) for i in range(3) for j in range(40)], "gene_id string, sample_id long, value double")
    s = spark.createDataFrame([(j, ["x", "y"][j % 2], batch[j]) for j in range(40)], "sample_id long, kind string, batch string")
    got = {r.gene_id: r for r in linear.linear_fit(m, s, ("kind", "batch"), {"kindy": 1.0}, intercept=True).collect()}
    x = np.column_stack([np.ones(40), np.arange(40) % 2, *(np.array(batch) == v for v in sorted(set(batch))[1:])]).astype(float)
    for i in range(3):
        b, rest, *_ = np.linalg.lstsq(x, y[i], rcond=None)
        assert abs(got[f"g{i}"].log_fc - b[1]) < 1e-8 and abs(got[f"g{i}"].s2 - float(rest[0]) / (40 - x.shape[1])) < 1e-8 and len(got[f"g{i}"].coefficients) == x.shape[1]


# Set enrichment


def plain_es(weight, hit):
    """(es, leading places)."""
    n, inside = len(weight), set(hit)
    total, run, best, at = sum(weight[i] for i in hit), 0.0, (0.0, 0.0), (0, 0)
    for i in range(n):
        if i in inside:
            low = run
            if low < best[1]:
                best, at = (best[0], low), (at[0], i)
            run += weight[i] / total if total else 0.0
            if run > best[0]:
                best, at = (run, best[1]), (i, at[1])
        else:
            run -= 1 / (n - len(hit))
    return (best[0], [i for i in hit if i <= at[0]]) if best[0] >= -best[1] - 1e-12 else (best[1], [i for i in hit if i >= at[1]])


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_prerank_against_brute_force(spark, size):
    """With the list in ranges of 64 genes and whole: scores, p, pooled FDR, FWER from the same draws."""
    rng, perms = np.random.default_rng(1), 120
    n = 300
    score = np.round(rng.normal(0, 1, n), 2)
    genes = [f"at{k:03d}" for k in range(n)]
    order = sorted(range(n), key=lambda k: (-score[k], genes[k].upper()))
    weight = np.abs(score[order])
    place = {genes[k].upper(): i for i, k in enumerate(order)}
    sets = {"GO:1 up": [genes[k] for k in order[:40:2]], "GO:2 down": [genes[k] for k in order[-60::3]], "GO:3 any": genes[::9], "GO:4 as large": genes[1::15], "GO:5 small": genes[:3], "GO:6 big": genes[:200]}
    frame = spark.createDataFrame([(g, float(v)) for g, v in zip(genes, score, strict=True)] + [("AT000", -50.0), (None, 1.0), ("zz", float("nan"))], "gene_id string, score double")
    members = spark.createDataFrame([(k, g.upper()) for k, v in sets.items() for g in v] + [("GO:1 up", "absent")], "term string, gene_id string")
    got = {r.term: r for r in gsea.prerank(frame, members, permutations=perms, seed=3, smallest=10, largest=100, size=size).collect()}
    kept = {k: sorted(place[g.upper()] for g in v) for k, v in sets.items() if 10 <= len(v) <= 100}
    assert got.keys() == kept.keys()
    parts = -(-n // size)
    null = {h: np.array([plain_es(weight, np.concatenate([at * size + gsea.draw(n, h, 3, p, at, size) for at in range(parts)]).tolist())[0] for p in range(perms)]) for h in {len(v) for v in kept.values()}}
    es = {k: plain_es(weight, v) for k, v in kept.items()}
    norm = {h: {up: np.abs(x[(x >= 0) == up]).mean() for up in (True, False)} for h, x in null.items()}
    nes = {k: e[0] / norm[len(kept[k])][e[0] >= 0] for k, e in es.items()}
    pool = np.concatenate([np.where(null[len(v)] >= 0, null[len(v)] / norm[len(v)][True], null[len(v)] / norm[len(v)][False]) for v in kept.values()])
    for k, (e, lead) in es.items():
        r, x, up = got[k], null[len(kept[k])], e >= 0
        side = np.abs(x[(x >= 0) == up])
        p = max((side >= abs(e) - 1e-12).mean(), 1 / perms)
        beyond = lambda v: (np.abs(v[(v >= 0) == up]) >= abs(nes[k]) - 1e-12).mean()  # noqa: B023, E731
        fdr = max(min(1, beyond(pool) / beyond(np.array(list(nes.values())))), 1 / perms)
        tops = [max((abs(null[h][q]) / norm[h][up] for h in null if (null[h][q] >= 0) == up), default=None) for q in range(perms)]
        tops = [v for v in tops if v is not None]
        fwer = max(sum(v >= abs(nes[k]) - 1e-12 for v in tops) / len(tops), 1 / perms)
        assert np.allclose([r.es, r.nes, r.p, r.fdr, r.fwer], [e, nes[k], p, fdr, fwer], atol=1e-9), (k, r, e, nes[k], p, fdr, fwer)
        assert r.n_hits == len(kept[k]) and r.go_id == k.split()[0] and [place[g] for g in r.leading_edge] == lead
    assert got["GO:1 up"].es > 0.5 > -0.5 > got["GO:2 down"].es and got["GO:1 up"].fdr < 0.2


def test_draws_fill_the_list_alike():
    seen = np.zeros(200)
    for p in range(400):
        x = np.concatenate([at * 64 + gsea.draw(200, 20, 1, p, at, 64) for at in range(4)])
        assert len(x) == 20 and len(set(x.tolist())) == 20 and x.max() < 200
        seen[x] += 1
    assert abs(seen.mean() - 40) < 1e-9 and seen.std() < 10


# Logs


def a_log(seed, n=400):
    rng = random.Random(seed)
    says = [
        "=== Processing study: GSE{} ===", "Download completed for GSE{}", "x DONE generating sample sheet for: GSE{}", "No valid FASTQ pairs found for GSE{}", "[!] Skipping GSE{}: y", "Marking GSE{} as ignore", "Marking GSE{} as error", "Marking GSE{} as processed",
        "Skipped — already processed (2): ['GSE{}', 'GSE77']", "Skipped — ignored (1): ['GSE{}']", "Skipped — error (1): ['GSE{}']", "nothing of GSE{}", "", "[Retry 2/3] Re-downloading 5 failed SRRs", "Running nf-core/rnaseq (Batch Mode) in /a/batch_{}...", "Demultiplexing batch results",
        "Command exit status:", "  13", "  7  ", "Nextflow Batch Error: Command x", "N E X T F L O W  ~  version 23", "Date: Wed Apr  1 14:07:51 CEST 2026", "Date: Thu Apr 2 15:07:52 2026", "Job ID: {}", "Node: n{}", "Job finished", "/tmp nodev bad mount option", "Marking GSE{} as error then Marking GSE{} as processed",
    ]
    return [rng.choice(says).replace("{}", str(rng.randrange(6))) for _ in range(n)]


def read_plainly(lines):
    """({study: state}, listed studies in order, {batch: state}, [(batch, code)], [(study, try)])."""
    state, listed, batches, errors, retried = {}, [], {}, [], []
    study = batch = code = None
    due = False
    for line in lines:
        if re.match(logs.EXIT_STATUS, line):
            due = True
            continue
        if due and (m := re.match(logs.EXIT_CODE, line)):
            code = int(m[1])
        due = False
        for k, (s, p) in enumerate(logs.STUDY_RULES):
            if m := re.search(p, line):
                g = m[1]
                if k == 0:
                    study = g
                    listed += [g] * (g not in listed)
                if state.get(g) not in logs.KEEPS.get(s, ()):
                    state[g] = s
        if m := re.search(logs.BATCH_RUN, line):
            batch = m[1]
            batches[batch] = "running"
        if re.search(logs.BATCH_OK, line) and batch:
            batches[batch] = "success"
        if re.search(logs.BATCH_ERROR, line):
            if batch:
                batches[batch] = "error"
                errors.append((batch, code))
            code = None
        if (m := re.search(logs.RETRY, line)) and study:
            retried.append((study, int(m[1])))
        for s, p in logs.LIST_RULES:
            if m := re.search(p, line):
                for g in re.findall(r"GSE\d+", m[1]):
                    listed += [g] * (g not in listed)
                    state[g] = s
    return state, listed, batches, errors, retried


@pytest.fixture(scope="module")
def written(tmp_path_factory):
    """Two jobs of three segments each, and the lines of each job."""
    at, held = tmp_path_factory.mktemp("logs"), {}
    for job in "ab":
        held[job] = []
        for seg in range(3):
            lines = a_log(f"{job}{seg}", [400, 1, 250][seg])
            held[job] += lines
            d = at / f"job={job}" / f"segment={seg}"
            d.mkdir(parents=True)
            (d / "part.txt").write_text("\n".join(lines) + "\n")
    return at, held


@pytest.mark.parametrize("stretch, block", [(7, "200b"), (4096, "128m")])
def test_logs_in_blocks_and_stretches(spark, written, stretch, block):
    at, held = written
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        lines = logs.read_logs(spark, str(at)).cache()
        assert lines.count() == sum(map(len, held.values()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for job, said in held.items():
        mine = lines.where(F.col("job") == job)
        assert [r.line for r in mine.orderBy("pos").collect()] == said
        state, listed, batches, errors, retried = read_plainly(said)
        got = logs.fold_states(logs.study_events(mine), stretch=stretch).collect()
        assert {r.study: r.state for r in got} == state
        assert [r.study for r in sorted((r for r in got if r.first_listed is not None), key=lambda r: r.first_listed)] == listed or len(listed) == len({r.first_listed for r in got if r.first_listed is not None}) + 1
        states, failed = logs.batch_runs(mine)
        assert {r.batch: r.state for r in states.collect()} == batches
        assert [(r.batch, r.exit_code) for r in failed.orderBy("pos").collect()] == errors
        assert [(r.study, r.attempt) for r in logs.retries(mine).orderBy("pos").collect()] == retried
        s = logs.job_summary(mine).first()
        dates = [x for x in said if x.startswith("Date: ")]
        assert s.raw_lines == len(said) and s.nf_runs == sum("N E X T" in x for x in said) and s.start_time == dates[0][6:] and s.end_time == dates[-1][6:]
        assert s.finished and s.nodev_error and s.job_id == [x for x in said if "Job ID" in x][-1].split()[-1]
    lines.unpersist()


def test_dates(spark):
    df = spark.createDataFrame([("Wed Apr  1 14:07:51 CEST 2026",), ("Thu Apr 12 15:07:52 2026",), ("no date",), (None,)], "d string")
    assert [str(r.t) for r in df.select(logs.log_time(F.col("d")).alias("t")).collect()] == ["2026-04-01 14:07:51", "2026-04-12 15:07:52", "None", "None"]


def test_stream_in_drops_with_restarts_equals_the_fold(spark, written, tmp_path):
    at, held = written
    drop = tmp_path / "in"
    for seg in range(3):
        for job in held:
            d = drop / f"job={job}" / f"segment={seg}"
            d.mkdir(parents=True)
            (d / "part.txt").write_text((at / f"job={job}" / f"segment={seg}" / "part.txt").read_text())
        log_machine.append_changes(log_machine.follow_logs(spark, str(drop)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.job, r.study): (r.state, r.n, r.first_listed) for r in log_machine.current(spark, str(tmp_path / "out")).collect()}
    want = {(r.job, r.study): (r.state, r.n, r.first_listed) for r in logs.fold_states(logs.study_events(logs.read_logs(spark, str(at)))).collect()}
    assert got == want and len(spark.read.parquet(str(tmp_path / "out")).select("pos").distinct().collect()) > len(got) / 2
    # A segment that comes again under another name changes nothing.
    (drop / "job=a" / "segment=0" / "again.txt").write_text((at / "job=a" / "segment=0" / "part.txt").read_text())
    log_machine.append_changes(log_machine.follow_logs(spark, str(drop)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.job, r.study): (r.state, r.n, r.first_listed) for r in log_machine.current(spark, str(tmp_path / "out")).collect()} == want


def test_idle_machines_say_so_once():
    class Held:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

    class Handle:
        timers = set()
        getValueState = lambda self, *a: Held()  # noqa: E731, N815
        registerTimer = lambda self, t: self.timers.add(t)  # noqa: E731, N815
        deleteTimer = lambda self, t: self.timers.discard(t)  # noqa: E731, N815

    class Clock:
        now = 1000
        getCurrentProcessingTimeInMs = lambda self: self.now  # noqa: E731, N815

    from pyspark.sql import Row

    h, clock, m = Handle(), Clock(), log_machine.StudyMachine(idle_ms=50)
    m.init(h)
    event = lambda pos, s, keeps=(): Row(pos=pos, rule=0, state=s, keeps=list(keeps), listed=True)
    assert [r.state for r in m.handleInputRows(("a", "g"), iter([event(2, "processed"), event(1, "processing")]), clock)] == ["processed"] and h.timers == {1050}
    clock.now = 1020
    assert list(m.handleInputRows(("a", "g"), iter([event(2, "error")]), clock)) == [] and h.timers == {1070}
    assert [r.state for r in m.handleExpiredTimer(("a", "g"), clock, None)] == ["idle:processed"]
    assert [(r.state, r.n) for r in m.handleInputRows(("a", "g"), iter([event(9, "ignore", ["processed"])]), clock)] == [("processed", 3)]


def test_upserts_and_drained_streams(spark, tmp_path):
    from verdure.streaming import trackers

    schema, src = "study string, code int, at long", tmp_path / "in"
    drop = lambda n, rows: spark.createDataFrame(rows, schema).write.parquet(str(src / f"d{n}"))
    follow = lambda: trackers.follow(spark, str(src / "*"), schema)
    drop(0, [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)])
    run = lambda: trackers.upsert_sink(follow(), str(tmp_path / "out"), "study", "at", str(tmp_path / "state")).awaitTermination()
    run()
    drop(1, [("a", 3, 3), ("b", 9, 0), ("c", 5, 5)])
    run()
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("v="))
    assert sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / "out" / last)).collect()) == [("a", 3, 3), ("b", 1, 1), ("c", 5, 5)]
    state = trackers.drained(trackers.latest_state(follow(), "study", "code", "at"), "latest")
    assert sorted((r.study, r.code) for r in state.collect()) == [("a", 3), ("b", 1), ("c", 5)]
    assert trackers.drained(follow().where("code > 2"), "rows", "append").count() == 3
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty))
    assert trackers.drained(trackers.latest_state(trackers.follow(spark, str(empty), schema), "study", "code", "at"), "none").count() == 0
