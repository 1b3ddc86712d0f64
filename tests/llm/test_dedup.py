import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import by_id

from verdure.llm import byte_dedup, common, simhash, window_dedup
from verdure.llm.components import components


def order(i):
    return -(2**63) if i is None else i


def test_fingerprints_and_components_against_brute_force(docs, rows):
    fp = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), order(i))
    want = sorted((order(i), fp[k], least[find(k)]) for k, (i, _) in enumerate(rows))
    got = sorted((r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_links_in_long_lists_join_the_same_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**62, 40)
    fps = sorted({int(b) ^ (1 << int(k)) for b in base for k in rng.integers(0, 62, 30)} | {int(b) for b in base})
    entries = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    short, long = (dict(map(tuple, components(simhash.links(entries, list_size=n)).collect())) for n in (4, 10**6))
    assert short == long
    near = np.bitwise_count(np.array(fps)[:, None] ^ np.array(fps)[None, :]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert [short.get(i, i) for i in range(len(fps))] == label.tolist()


def test_components_of_chains_stars_and_nothing(spark):
    e = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(units, ids, n):
    """Flags of units covered by an n-gram that also starts under a smaller id."""
    first = {}
    for i, u in zip(ids, units, strict=True):
        for k in range(len(u) - n + 1):
            g = u[k : k + n] if isinstance(u, bytes) else tuple(u[k : k + n])
            first[g] = min(first.get(g, 2**63), order(i))
    out = []
    for i, u in zip(ids, units, strict=True):
        gone = [False] * len(u)
        for k in range(len(u) - n + 1):
            g = u[k : k + n] if isinstance(u, bytes) else tuple(u[k : k + n])
            if first[g] < order(i):
                gone[k : k + n] = [True] * n
        out.append(gone)
    return out


def spans(gone):
    out, start = [], None
    for k, g in enumerate([*gone, False]):
        if g and start is None:
            start = k
        if not g and start is not None:
            out.append((start, k))
            start = None
    return out


def test_bytes_against_brute_force(docs, rows):
    ids, texts = [i for i, _ in rows], [(t or "").encode() for _, t in rows]
    want = sorted((order(i), len(t), spans(g), hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()) for i, t, g in zip(ids, texts, removed(texts, ids, 50), strict=True))
    found = byte_dedup.remove_repeats(docs).withColumn("h", F.sha2("kept", 256)).collect()
    assert sorted((r.id, r.n, [tuple(s) for s in r.spans], r.h) for r in found) == want
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in found) and sum(r.n_removed for r in found) > 1000


def test_words_against_brute_force(docs, rows):
    ids, words = [i for i, _ in rows], [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    want = sorted((order(i), len(w), spans(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for i, w, g in zip(ids, words, removed(words, ids, 13), strict=True))
    found = window_dedup.remove_repeats(docs).collect()
    assert sorted((r.id, r.n, [tuple(s) for s in r.spans], r.kept) for r in found) == want


def test_text_keeps_whole_characters(spark):
    a = "x" + "é" * 40
    got = byte_dedup.remove_repeats(spark.createDataFrame([(1, "é" * 30), (2, a)], "doc_id long, text string"), as_text=True).where("id = 2").first()
    assert got.kept == "x" and got.n_removed == 80
    with pytest.raises(ValueError):
        byte_dedup.remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=10)


def test_empty_tables(none):
    assert simhash.near_duplicates(none).count() == byte_dedup.remove_repeats(none).count() == window_dedup.remove_repeats(none).count() == 0


def test_null_ids_come_back_as_null(docs):
    assert by_id(byte_dedup.remove_repeats(docs).select(common.real_id(), "n"))[0][0] is None
