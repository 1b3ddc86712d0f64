"""Sinks that are killed and run again, facts, and matrix files with headers of their own."""

import pytest
from pyspark.sql import functions as F

from verdure.sources import durable, readers


def test_killed_and_repeated_writes_leave_one_result(spark, tmp_path):
    path, made = str(tmp_path / "r"), []

    def make(n=5):
        made.append(n)
        return spark.range(n).select((-F.col("id")).alias("id"))

    def dies():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        durable.write_once(spark, path, dies)
    spark.range(99).write.parquet(f"{path}.stage")  # a stage that was left
    assert durable.write_once(spark, path, make, ("id",)) and not durable.exists(spark, f"{path}.stage")
    assert [r.id for r in spark.read.parquet(path).collect()] == [-4, -3, -2, -1, 0]
    assert not durable.write_once(spark, path, dies) and made == [5]
    durable.remove(spark, f"{path}/{durable.DONE}")  # killed after the move
    assert durable.write_once(spark, path, lambda: make(3)) and spark.read.parquet(path).count() == 3
    short = str(tmp_path / "short")
    assert durable.write_once(spark, short, make, least=9) and not durable.is_done(spark, short) and durable.write_once(spark, short, lambda: make(9), least=9) and durable.is_done(spark, short)
    assert durable.write_once(spark, str(tmp_path / "none"), lambda: make(0)) and spark.read.parquet(str(tmp_path / "none")).count() == 0


def test_lists_are_archived_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    lists = [spark.createDataFrame([("s", x) for x in xs], "study_id string, sample string") for xs in (["a", "b", "b"], ["c"], ["d", "e"])]
    assert durable.replace_list(lists[0], path, "t1") and [tuple(r) for r in durable.missing_now(spark, path).collect()] == [("s", ["a", "b"], 2)]
    moves = []

    def move(s, old, new, real=durable.move):
        moves.append(new)
        if len(moves) == 2:
            raise OSError("killed")
        real(s, old, new)

    monkeypatch.setattr(durable, "move", move)
    with pytest.raises(OSError):
        durable.replace_list(lists[1], path, "t2")  # archived, not yet replaced
    monkeypatch.undo()
    assert durable.replace_list(lists[1], path, "t2") and not durable.replace_list(lists[1], path, "t2")
    assert durable.replace_list(lists[2], path, "t3") and durable.missing_now(spark, path).first().samples == ["d", "e"]
    old = spark.read.parquet(f"{path}/archive")
    assert sorted((r.until, r.sample) for r in old.collect()) == [("t2", "a"), ("t2", "b"), ("t2", "b"), ("t3", "c")]


def test_facts_and_runs(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = [("s", "status", "1", 1), ("s", "status", "2", 3), ("s", "status", "4", 2), ("s", "ecotype", "Col-0", 1), ("t", "meta", '{"platform": "P", "has_raw": true}', 1), ("u", "meta", "broken", 1), ("v", "other", "x", 1)]
    df = spark.createDataFrame(rows, "study_id string, kind string, value string, n int").withColumn("at", F.timestamp_seconds("n"))
    durable.append_facts(df.where("n < 3"), path)
    durable.append_facts(df.where("n = 3"), path)
    facts = durable.current_facts(spark, path, ("status", "ecotype", "meta"))
    assert {r.study_id: (r.status, r.ecotype) for r in facts.collect()} == {"s": ("2", "Col-0"), "t": (None, None), "u": (None, None)}
    assert [tuple(r) for r in durable.study_report(facts).collect()] == [("t", "P", 0, True)] and durable.latest_status(spark, path).first().value == "2"
    runs = str(tmp_path / "runs")
    assert durable.log_run(spark, runs, "r1", "2026-01-01 10:00:00", bins=100) and not durable.log_run(spark, runs, "r1", "2026-01-02") and durable.log_run(spark, runs, "r2", "2026-01-03", "why")
    assert {r.run_id: (r.notes, dict(r.settings)) for r in spark.read.parquet(runs).collect()} == {"r1": ("(none provided)", {"bins": "100"}), "r2": ("why", {})}


def test_missing_sample_files(spark, tmp_path):
    (tmp_path / "GSE1_missing_samples.txt").write_text("SRR2\n\n SRR1 \n")
    (tmp_path / "GSE2_missing_samples.txt").write_text("\n")
    (tmp_path / "GSE3.txt").write_text("2\n")
    assert [tuple(r) for r in durable.missing_lists(spark, str(tmp_path)).collect()] == [("GSE1", ["SRR2", "SRR1"], 2)]


@pytest.mark.parametrize("block", ["40b", "128m"])
def test_matrix_files_with_their_own_headers(spark, tmp_path, block):
    (tmp_path / "a.csv").write_text('gene,"s,1",s2.x\ng1,1,2\n"g,2",3,\ng3,x,"4"\n')
    (tmp_path / "b.csv").write_text('s9,gene,s2\n5,g1,6\n"7","g""4",8\ns9,gene,s2\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {(r.gene_id, r.sample_id, r.value) for r in readers.wide_csv(spark, str(tmp_path), gene="gene").collect()}
        few = {(r.gene_id, r.sample_id) for r in readers.wide_csv(spark, str(tmp_path), gene="gene", samples=("s9",)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    a = {("g1", "s,1", 1.0), ("g1", "s2", 2.0), ("g,2", "s,1", 3.0), ("g,2", "s2", None), ("g3", "s,1", None), ("g3", "s2", 4.0)}
    b = {("g1", "s9", 5.0), ("g1", "s2", 6.0), ('g"4', "s9", 7.0), ('g"4', "s2", 8.0), ("gene", "s9", None), ("gene", "s2", None)}
    assert got == a | b and few == {("g1", "s9"), ('g"4', "s9"), ("gene", "s9")}
    with pytest.raises(Exception, match="no column s9"):
        readers.wide_csv(spark, str(tmp_path), gene="s9").collect()


def test_many_lists_in_few_files(spark, tmp_path):
    """The number of files is that of partitions, not of studies; lists stay whole and in order."""
    path = str(tmp_path / "lists")
    rows = [(f"GSE{k % 300}", f"SRR{k}", k) for k in range(3000)]
    durable.write_missing_lists(spark.createDataFrame(rows, "study_id string, sample string, at long").repartition(7), path, "at")
    assert len([x for x in (tmp_path / "lists").iterdir() if x.name.startswith("part-")]) <= 4
    got = {r.study_id: (r.samples, r.n) for r in durable.missing_lists(spark, path).collect()}
    assert got == {f"GSE{j}": ([f"SRR{k}" for k in range(j, 3000, 300)], 10) for j in range(300)}
