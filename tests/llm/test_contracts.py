"""The opN_ queries on a small folder of tables: columns, types, rows, and SQL where there is some."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from tests.llm.test_tokens import check_pieces, whole

from verdure.llm import queries

COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op3_suffix_array": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_decontamination": "doc_id bigint, item_id bigint",
    "op9_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_fill_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op12_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """documents with null and repeated ids and texts, pages, labels and a benchmark of two of the texts' stretches."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, f"u{k}", None if k % 9 == 0 else f"<p>{k % 5}</p>") for k in range(40)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(rows) if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    long = max((t for _, t in rows if t), key=len).split()
    spark.createDataFrame([(k, " ".join(long[100 * k + 7 : 100 * k + 50])) for k in range(2)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture(scope="module")
def got(spark, folder):
    return {name: (df := q(spark, folder), df.collect()) for name, q in queries.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(got, name):
    df, _ = got[name]
    kinds = dict(df.dtypes)
    assert all(kinds[c.split()[0]] == c.split()[1] for c in COLUMNS[name].split(", ")) and list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", ["op4_warc", "op7_quality_rules"])
def test_sql(got, folder, name):
    df, rows = got[name]
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(repr([r[k] for k in cols]) for r in rows) == sorted(repr([r[want.columns.index(k)] for k in cols]) for r in want.fetchall())


def test_rows(got, rows):
    """A row a document where the contract says so; ids, digests and folds by the contract's own words."""
    ids = sorted(map(str, (i for i, _ in rows)))
    for name in ("op1_simhash", "op2_token_output", "op3_suffix_array", "op5_lm_scoring", "op6_quality_classifier", "op7_quality_rules", "op9_substring_dedup", "op11_fill_middle", "op12_sentencepiece", "op13_alignment"):
        assert sorted(str(r.doc_id) for r in got[name][1]) == ids, name
    once = {i: t or "" for i, t in rows if i is not None and sum(i == j for j, _ in rows) == 1}
    tok = whole("word_bpe_49k.json")
    for r in got["op2_token_output"][1]:
        if r.doc_id in once:
            x = [*tok.encode(once[r.doc_id], add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    starts = sorted((r.start, r.n_tokens) for r in got["op2_token_output"][1])
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    for r in got["op3_suffix_array"][1]:
        if r.doc_id in once and not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(once[r.doc_id].encode()).hexdigest() and r.n_bytes == len(once[r.doc_id].encode())
    for r in got["op9_substring_dedup"][1]:
        if r.doc_id in once and not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", once[r.doc_id])).encode()).hexdigest()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in got["op1_simhash"][1])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and math.isfinite(r.score) for r in got["op5_lm_scoring"][1] if r.doc_id is not None)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got["op6_quality_classifier"][1] if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got["op6_quality_classifier"][1])
    assert check_pieces(got["op10_packing"][1]) == 0
    assert {(r.doc_id, r.item_id) for r in got["op8_decontamination"][1]} == {(7, 0), (7, 1)}
