"""Operator 12 against the sentencepiece library itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import by_id

from verdure.llm import common, pieces

PATH = pieces.public_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def agree(model, library, texts):
    ids, counts = model.encode(texts, True)
    want = [library.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == want[0] and ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))
    assert model.decode(ids, counts) == [library.decode(x) for x in want]


def test_mixed_texts(model, library):
    rng = random.Random(3)
    bits = ["a", "b", "c", "e", "t", "h", "▁", " ", "  ", "\n", "é", "日", "本", "0", "1", "\0", "\U0001f600", "<s>", "<0x41>", "in", "the", "​", "ﬁ", "\t"]
    agree(model, library, ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(4000)])


@pytest.mark.parametrize("letters", ["ab", "aehtinsor", "-=_", "0123a", " a"])
def test_long_words_where_merges_hang_together(model, library, letters):
    rng = random.Random(5)
    agree(model, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(400)])


def test_very_long_texts(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "STRETCH", 5000)
    rng = random.Random(6)
    agree(model, library, ["a" * 60_000, " " * 12_001, "".join(rng.choice("etaoin") for _ in range(20_000)), " ".join(rng.choice(["the", "▁", "ation", "日本"]) for _ in range(20_000)), "", "x"])


def test_any_ids_decode(model, library):
    rng = random.Random(7)
    some = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32_000)]) for _ in range(rng.randrange(12))] for _ in range(4000)]
    assert model.decode(np.array([i for x in some for i in x], np.int64), np.array(list(map(len, some)))) == [library.decode(x) for x in some]


def test_memo_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 10)
    small = pieces.PieceModel(PATH)
    for k in range(3):
        agree(small, library, [f"some words of {k} and more of {w}" for w in range(40)])


def test_round_trip_of_a_table(spark, docs, rows, library):
    done = pieces.decode(pieces.encode(docs)).withColumn("list", pieces.unpacked())
    got = by_id(done.select(common.real_id(), "list", "text"))
    key = lambda r: (r[0] is not None, r[0] or 0, repr(r))
    want = sorted([(i, library.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in rows], key=key)
    assert got == [(i, x, library.decode(x)) for i, x, _ in want] and all(library.decode(x) == t for _, x, t in want)


def test_no_rows_null_ids_and_clashing_names(spark, none):
    assert pieces.decode(pieces.encode(none)).count() == 0
    odd = spark.createDataFrame([(1, None, 5), (2, bytearray(b""), 6)], "id long, ids binary, c0 int")
    assert [tuple(r) for r in pieces.decode(odd).select("id", "c0", "text").orderBy("id").collect()] == [(1, 5, ""), (2, 6, "")]
    assert odd.select(F.size(pieces.unpacked()).alias("n")).distinct().collect()[0].n == 0
