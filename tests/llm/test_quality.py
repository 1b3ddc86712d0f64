import collections
import re

import numpy as np
from tests.llm.conftest import by_id

from verdure.llm import quality_model, quality_rules


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


EXTRA = [(5000, "a b\na b\n\n \na b\nc"), (5001, "spam ham " * 60), (5002, "x** y## " * 30), (5003, "SHOUT LOUD NOW " * 9 + "tail of other words so that it is long enough to count " * 1), (5004, "one two three four five six seven eight nine ten " * 2)]


def test_figures_and_verdicts(spark, rows):
    every = rows + EXTRA
    docs = spark.createDataFrame([(i, t, "z") for i, t in every], "doc_id long, text string, n_words string")
    got = sorted((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs, figures=True).collect())
    want = []
    for i, t in every:
        f = slow(t or "")
        want.append((-(2**63) if i is None else i, *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert got == sorted(want)


def test_order_changes_no_verdict_and_filter_keeps_columns(docs):
    names = list(quality_rules.RULES)
    kept = [sorted(r.id for r in quality_rules.judge(docs, o).where("rejected_by IS NULL").collect()) for o in (names, names[::-1])]
    assert kept[0] == kept[1] and sorted(quality_rules.rule_order(docs)) == sorted(names)
    left = quality_rules.passing(docs)
    assert left.schema == docs.schema and sorted(-(2**63) if r.doc_id is None else r.doc_id for r in left.collect()) == kept[0]


def test_empty(none):
    assert quality_rules.judge(none, figures=True).count() == 0 and quality_rules.passing(none).count() == 0


def test_rules_learn_and_compile(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_model.FIGURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 9] < 0.6)).astype(float)
    model = quality_model.fit(x, y)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{k} double" for k in quality_model.FIGURES))
    got = np.array([r[0] for r in df.select(quality_model.compiled(model)).collect()])
    z = model[0] + sum(w * quality_model._fires(x, r) for r, w in model[1])
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == y).mean() > 0.97 and 0 < len(model[1]) < 150


def test_scores_every_row(spark, docs, rows, none):
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(rows)] + [(None, 1, 0), (10**9, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = by_id(quality_model.score_quality(docs, labels))
    assert len(got) == len(rows) and all(0 <= r[2] <= 1 for r in got)
    assert all(r[2] == 0.5 for r in quality_model.score_quality(docs, labels.where("false")).collect())
    assert quality_model.score_quality(none, labels).count() == 0


def test_accuracy_on_labels_held_out(spark):
    """The query's scores on a test table, against the labels it must not learn from."""
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.predicted, r.score, label[r.doc_id]) for r in quality_model.op6_quality_classifier(spark, sf).collect() if r.held_out and label.get(r.doc_id) is not None]
    right = np.mean([p == y for p, _, y in got])
    good, bad = ([s for _, s, y in got if y == k] for k in (1, 0))
    assert len(got) > 50 and min(len(good), len(bad)) > 5 and right > 0.95 and np.mean([a > b for a in good for b in bad]) > 0.97
