"""Labels, maps, batches and reviews against small hand-made cases."""

import json

import pytest
from pyspark.sql import functions as F

from verdure.sources import label_store as store


def test_labels_round_trip_with_quotes_and_gaps(spark, tmp_path):
    rows = [("s1", "a", "tissue", 'le"af'), ("s1", "a", "tissue", 'le"af'), ("s1", "a", "treatment", "x, y"), ("s1", "b", "tissue", None), ("s2", "c", "tissue", "root\\n")]
    df = spark.createDataFrame(rows, "study_id string, sample_id string, axis string, label string")
    store.write_labels(df, str(tmp_path / "l"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "l")).select("value").collect()]
    assert sorted(lines, key=lambda x: x["id"]) == [{"id": "a", "tissue": ['le"af'], "treatment": ["x, y"]}, {"id": "b", "tissue": []}, {"id": "c", "tissue": ["root\\n"]}]
    got = sorted(map(tuple, store.condensed(spark, str(tmp_path / "l")).collect()), key=str)
    assert got == sorted({("s1", "a", "tissue", 'le"af'), ("s1", "a", "treatment", "x, y"), ("s1", "b", "tissue", None), ("s2", "c", "tissue", "root\\n")}, key=str)


def test_single_pairs(spark):
    schema = "study_id string, sample_id string, axis string, label string"
    raw = spark.createDataFrame([("s", "a", "t", "x"), ("s", "b", "t", "x"), ("s", "b", "t", "y"), ("s", "c", "t", "x"), ("s", "c", "t", None)], schema)
    grounded = spark.createDataFrame([("s", "a", "t", "X"), ("s", "b", "t", "X"), ("s", "c", "t", "X"), ("s", "d", "t", "X")], schema)
    assert sorted((r.sample_id, r.raw, r.grounded) for r in store.single_pairs(raw, grounded).collect()) == [("a", "x", "X"), ("c", "x", "X")]


def test_map_first_label_stays_over_saves(spark, tmp_path):
    schema = "study_id string, sample_id string, axis string, raw string, grounded string, at int"
    one = spark.createDataFrame([("s1", "a", "t", "x", "X2", 2), ("s1", "b", "t", "x", "X1", 1), ("s1", "b", "t", "x", "X1", 1), ("s2", None, "t", "x", "X3", 3), ("s1", "a", "other", "x", "O", 0), ("s1", "a", "t", None, "N", 0)], schema)
    two = spark.createDataFrame([("s2", "c", "t", "x", "X0", 0), (None, "z", "t", "y", "Y", 1), ("s3", None, "t", "y", "Y0", 5)], schema)
    path = str(tmp_path / "m")
    for k, pairs in enumerate((one, two)):
        store.save_map(*store.add_pairs(*store.load_map(spark, f"{path}{k}"), pairs, ("t",)), f"{path}{k + 1}")
    labels, seen = store.load_map(spark, f"{path}2")
    assert sorted(map(tuple, labels.collect())) == [("t", "x", "X1"), ("t", "y", "Y")]
    assert sorted(map(tuple, seen.collect()), key=str) == sorted([("t", "x", "s1", "a"), ("t", "x", "s1", "b"), ("t", "x", "s2", "c"), ("t", "y", "s3", None)], key=str)
    with pytest.raises(Exception, match="(?i)exists"):
        store.save_map(labels, seen, f"{path}2")


def test_batch_by_study(spark, tmp_path):
    cells = spark.createDataFrame([("g", s, 1.0) for s in ("a", "b", "c", "lost")], "gene_id string, sample_id string, value double")
    owner = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("b", "s2"), ("c", "s2"), ("c", "s2"), ("never", "s3"), ("x", None)], "sample_id string, study_id string")
    meta = spark.createDataFrame([("a", '{"num_processed": 10, "num_mapped": 5, "percent_mapped": 50.0}'), ("b", "{no"), ("other", "{}")], "sample_id string, json string")
    path = str(tmp_path / "b")
    saved = store.write_batch(cells, cells, owner, meta, path, None, "here", "now")
    assert sorted(map(tuple, saved.collect())) == [("s1", 2), ("s2", 2)]
    for name in ("counts", "tpm"):
        assert sorted((r.study_id, r.sample_id) for r in spark.read.parquet(f"{path}/{name}").collect()) == [("s1", "a"), ("s1", "b"), ("s2", "b"), ("s2", "c")]
    cov = spark.read.csv(f"{path}/coverage", header=True)
    got = sorted((r.study_id, r.Sample, r.Total_Reads_Processed, r.Reads_Mapped, r.Percent_Mapped, r.Batch_ID) for r in cov.collect())
    u = "unspecified"
    assert [(*x[:4], x[5]) for x in got] == [("s1", "a", "10", "5", "unknown"), ("s1", "b", u, u, "unknown"), ("s2", "b", u, u, "unknown"), ("s2", "c", u, u, "unknown")] and float(got[0][4]) == 50.0
    assert sorted((r.study_id, r["sample"], r.origin) for r in spark.read.json(f"{path}/batch").collect()) == [("s1", "a", "here"), ("s1", "b", "here"), ("s2", "b", "here"), ("s2", "c", "here")]


def test_reviewer_files(spark, tmp_path):
    for name, text in (("GSE1_GSM12_meta.json", '{"a": 1}'), ("GSE1_GSM123.json", '{"a": 2}'), ("x_GSM12.json", '{"a": 3}'), ("GSM9.json", "{broken")):
        (tmp_path / name).write_text(text)
    asked = spark.createDataFrame([("GSM12",), ("GSM123",), ("GSM9",), ("GSM1",), ("GSM12",)], "sample_id string")
    got = {r.sample_id: r.json for r in store.metadata_of(spark, f"{tmp_path}/*.json", asked).collect()}
    assert got == {"GSM12": '{"a": 1}', "GSM123": '{"a": 2}', "GSM9": None, "GSM1": None}
    assert store.reviews(spark, str(tmp_path / "none.csv")).count() == 0 and store.payload(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "r.csv").write_text('study_id,sample_id,label_scores,comments\ns,a,"{""t"": 1}","two\nlines"\n')
    (tmp_path / "u.csv").write_text("username,study_id,sample_id,label_scores\nme,s,a,{}\n")
    assert tuple(store.reviews(spark, str(tmp_path / "r.csv")).first()) == ("unknown_legacy_user", "s", "a", '{"t": 1}', "two\nlines")
    assert tuple(store.reviews(spark, str(tmp_path / "u.csv")).first()) == ("me", "s", "a", "{}", None)
    (tmp_path / "p.json").write_text('[{"id": "a"}, {"id": "b", "x": [1]}]')
    (tmp_path / "q.json").write_text('{"id": "a"}')
    assert [(r.pos, r.id) for r in store.payload(spark, str(tmp_path / "p.json")).select("pos", F.expr("variant_get(entry, '$.id', 'string')").alias("id")).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    assert store.payload(spark, str(tmp_path / "q.json")).count() == 0
