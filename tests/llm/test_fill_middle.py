"""Operator 11 against the contract's words, in Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import by_id

from verdure.llm import fill_middle as fm


def brute(doc_id, text, unit="char"):
    """(n, form, prefix, middle, output)."""
    text = text or ""
    if unit == "char":
        starts = list(range(len(text)))
    else:
        starts = [i for i, c in enumerate(text) if c not in " \t\n\x0b\x0c\r" and (i == 0 or text[i - 1] in " \t\n\x0b\x0c\r")]
    n = len(starts)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y = (0 if k == 0 else len(text) if k == n else starts[k] for k in (a, b))
    p, m, s = text[:x], text[x:y], text[y:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(rows):
    """The usual ones, and markers whole, broken and side by side, at chunk ends too."""
    rng = random.Random(4)
    odd = ["<", "<P", "a<P>b", "<<S>", "<M", "<PS>", "<P <S >", "é" * 127 + "a<M>", "x" * 254 + "<S>", "x" * 255 + "<S", "日本" * 300, " lead", "trail  ", "\U0001f600"]
    odd += ["".join(rng.choice("<PSM>aé 日") for _ in range(rng.randrange(700))) for _ in range(200)]
    return [*rows, *[(20_000 + k, t) for k, t in enumerate(odd)]]


def wanted(texts, unit="char"):
    out = []
    for i, t in texts:
        n, form, a, m, output = brute(i, t, unit)
        out.append((i, n, form, a, m, sha(output), sha(t or "")))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


@pytest.mark.parametrize("unit", ["char", "word"])
@pytest.mark.parametrize("giant, piece", [(1 << 20, 1 << 20), (300, 64), (20, 7)])
def test_all_forms_whole_and_in_pieces(spark, texts, unit, giant, piece):
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    ordinary, giants = fm.fill_in_middle(d, fm.Choice(unit=unit), giant, piece)
    assert (giants is not None) == (giant < 10_000)
    got = by_id(fm.digests(ordinary, giants).withColumn("id", F.when(F.col("id") != fm.common.NULL_ID, F.col("id"))))
    assert got == wanted(texts, unit)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_the_texts_themselves(spark, texts):
    d = spark.createDataFrame(texts, "doc_id long, text string")
    ordinary, giants = fm.fill_in_middle(d, giant=100, piece=33)
    rows, parts = giants
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("p")).join(rows, "key").collect()
    got = sorted([(r.id, b"".join(x.data for x in r.p).decode()) for r in whole] + [(r.id, bytes(r.output).decode()) for r in ordinary.collect()])
    assert got == sorted((fm.common.NULL_ID if i is None else i, brute(i, t)[4]) for i, t in texts)
    assert all(sum(len(x.data) for x in r.p) == r.p[-1].at + len(r.p[-1].data) for r in whole)


def test_composition_is_associative():
    rng = np.random.default_rng(0)
    state, count = rng.integers(0, 5, (40, 5)), rng.integers(0, 9, (40, 5, 2))
    first = np.repeat([0, 7, 8, 30], [7, 1, 22, 10])
    s, c = fm.compose(state, count, first)
    for i in range(40):
        for q in range(5):
            at, total = q, np.zeros(2, int)
            for j in range(first[i], i + 1):
                total, at = total + count[j, at], state[j, at]
            assert s[i, q] == at and (c[i, q] == total).all()


def test_no_rows_and_clashing_names(spark, none, docs, rows):
    ordinary, giants = fm.fill_in_middle(none)
    assert giants is None and fm.digests(ordinary, giants).count() == 0
    more = docs.select("*", *[F.lit(1).alias(c) for c in ("key", "at", "data", "n", "form", "h1", "output")])
    assert fm.digests(*fm.fill_in_middle(more, giant=50, piece=20)).count() == len(rows)
