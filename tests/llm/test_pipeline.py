import re

import corpus_pipeline as cp
import numpy as np
from tests.llm.test_dedup import order, removed
from tests.llm.test_quality import EXTRA, slow
from tests.llm.test_tokens import check_pieces, whole

from verdure.llm import simhash

LEAK = "quokka marsupial island habitat survey counted ninety adult females near the northern dune lagoon during early spring rains"


def brute_rules(rows):
    out = []
    for i, t in rows:
        n, chars, symbols, dup, repeated = slow(t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        upper = len(re.findall("[A-Z]", t or ""))
        bad = n < 20 or 100 * repeated > 30 * n or 100 * symbols > 10 * n or 100 * dup > 40 * len(lines) or not 3 * n <= chars <= 10 * n or 100 * upper > 30 * chars
        if not bad:
            out.append((i, t))
    return out


def brute_near(rows):
    fp = np.array([simhash.fingerprint((t or "").encode()) for _, t in rows], np.uint64)
    label = np.arange(len(rows))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    best = {}
    for k, (i, t) in enumerate(rows):
        if label[k] not in best or order(i) < order(best[label[k]][0]):
            best[label[k]] = (i, t)
    return list(best.values())


def brute_bytes(rows):
    texts = [(t or "").encode() for _, t in rows]
    return [(i, bytes(b for b, x in zip(t, g, strict=True) if not x).decode(errors="ignore")) for (i, _), t, g in zip(rows, texts, removed(texts, [i for i, _ in rows], 50), strict=True)]


def test_each_stage_on_what_the_one_before_kept(spark, rows, tmp_path):
    every = rows + EXTRA + [(7000, "before it " * 1 + " ".join(f"plain{k}" for k in range(40)) + " " + LEAK + " and after"), (7001, " ".join(f"other{k}" for k in range(60)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), every
    columns, seen = docs.columns, []
    brute = [brute_rules, brute_near, brute_bytes, lambda rows: [r for r in rows if LEAK not in r[1]], None]
    for (name, stage), slowly in zip(cp.STAGES, brute, strict=True):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if slowly:
            want = slowly(want)
            got = sorted(((order(r.doc_id), r.text or "", r.n_chars) for r in docs.collect()), key=repr)
            assert docs.columns == columns
            assert [g[:2] for g in got] == sorted(((order(i), t or "") for i, t in want), key=repr), name
            seen.append(len(got))
    assert seen[0] > seen[1] and seen[2] > seen[3] > 10
    pieces = docs.collect()
    assert check_pieces(pieces) == 0
    ref = whole("byte_bpe_50k.json")
    assert sum(r.length for r in pieces) == sum(len(ref.encode(t, add_special_tokens=False).ids) + 1 for _, t in want)
    assert cp.run(spark, str(tmp_path)).count() == len(pieces)


def test_an_id_links_nothing(spark, tmp_path):
    """Unlike texts under no id or the same id all stay; a leak takes its own row only."""
    prose = lambda k: " ".join(f"{k}{j}" for j in range(40))
    unlike = [(None, prose("qa")), (None, prose("wz")), (5, prose("er")), (5, prose("tx")), (6, prose("op"))]
    rows = [*unlike, (6, prose("op")), (5, f"{prose('vb')} {LEAK} and after"), (8, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(0, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    said = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=repr)
    once = cp.near_dedup(spark, docs, str(tmp_path))
    assert said(once) == sorted([*unlike, rows[6], (8, "")], key=repr)
    assert len(cp.substring_dedup(spark, docs, str(tmp_path)).collect()) == len(rows)
    assert said(cp.decontamination(spark, docs, str(tmp_path))) == sorted([(i, t or "") for i, t in rows if LEAK not in (t or "")], key=repr)


def test_columns_that_clash_and_empty_tables(spark, tmp_path):
    """Columns named like those used inside pass through; an empty table gives no rows at any stage."""
    names = ["k", "r", "id", "fp", "t", "kept", "stays", "leaks", "row", "root", "node", "was", "block", "a.b"]
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in ("qa", "wz")] + [f"{' '.join(f'er{k}' for k in range(40))} {LEAK}"]
    rows = [(k, t, "en", "s", len(t), *range(len(names))) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    spark.createDataFrame([(0, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    for (name, stage), left in zip(cp.STAGES[:-1], (3, 3, 3, 2), strict=True):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        assert sorted(map(tuple, out.collect())) == rows[:left], name
        none = stage(spark, docs.where("false"), str(tmp_path))
        assert none.columns == docs.columns and not none.collect()
    assert {r.doc_id for r in cp.pack(spark, docs, str(tmp_path)).collect()} == {0, 1, 2} and not cp.pack(spark, docs.where("false"), str(tmp_path)).collect()
