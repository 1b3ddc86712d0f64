"""Operator 13 against the contract's words, token by token in Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import by_id

from verdure.llm import alignment, common
from verdure.llm.tokens import byte_letters, public_path


@pytest.fixture(scope="module")
def both():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


def brute(both, texts):
    """{place: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}."""
    a, b = both
    to_byte = {chr(c): x for x, c in byte_letters().items()}
    out, links = {}, {}
    for k, (_, t) in enumerate(texts):
        out[k], links[k] = (0, 0, 0, 0, 0, 0, ""), []
        if not t:
            continue
        x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        spell_a = [bytes(to_byte[c] for c in s) for s in x.tokens]
        spell_b = [bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(spell_a) == b"".join(spell_b) == b" " + t.encode():
            continue
        groups, at, ga, gb, i, j = [], [0, 0], [], [], 0, 0
        while i < len(x.ids) or j < len(y):
            if at[0] <= at[1]:
                ga.append(x.ids[i])
                at[0] += len(spell_a[i])
                i += 1
            else:
                gb.append(y[j])
                at[1] += len(spell_b[j])
                j += 1
            if at[0] == at[1]:
                links[k].append((ga[-1], gb[-1]))
                groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
                ga, gb = [], []
        out[k] = (len(x.ids), len(y), len(groups), len(groups), 0, 0, ";".join(groups))
    count = Counter(p for v in links.values() for p in v)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return {k: (*v[:4], sum(count[p] == top[p[1]] for p in links[k]), sum(count[p] for p in links[k]), v[6]) for k, v in out.items()}


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(8)
    bits = ["the", " ", "  ", "\n", "é", "日本", "ation", "don't", "<|endoftext|>", "</s>", "<s>", "123", "\0", "\U0001f600", "​", "Ａ", "x", ".", "\t", "\x1c"]
    odd = ["▁", "a ▁b", "a▁ b", "<0x41>", " ", "   x", "<unk>"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [*rows, *[(30_000 + k, t) for k, t in enumerate(odd)]]


def found(spark, texts, text=True, parts=3):
    blocks = alignment.align(spark.createDataFrame(texts, "doc_id long, text string").repartition(parts), text=text)
    counts = alignment.pair_counts(blocks)
    return counts, alignment.per_document(blocks, counts).withColumn("id", F.when(F.col("id") != common.NULL_ID, F.col("id")))


def wanted(both, texts):
    w = brute(both, texts)
    return sorted([(i, *w[k]) for k, (i, _) in enumerate(texts)], key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


@pytest.mark.parametrize("stretch, block", [(1 << 20, 100_000), (50, 7)])
def test_against_brute_force(spark, both, texts, monkeypatch, stretch, block):
    """Whole, and with long texts in stretches and a block for every few rows."""
    blocks = alignment.Aligned(alignment.byte_side(public_path("byte_bpe_50k.json")), alignment.piece_side(public_path("piece_bpe_32k.model")), ["", "a ▁b"])
    assert not blocks.ok.any() and blocks.spelled == [b"", b""]
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    monkeypatch.setattr(alignment, "BLOCK_ROWS", block)
    held, a, b = alignment._Block(True), alignment.byte_side(public_path("byte_bpe_50k.json")), alignment.piece_side(public_path("piece_bpe_32k.model"))
    held.add(None, [t or "" for _, t in texts], a, b)
    want = brute(both, texts)
    for k in range(len(texts)):
        assert (*held.numbers[0][k].tolist(), held.groups[k]) == (*want[k][:3], want[k][6]), texts[k]


def test_table(spark, both, texts):
    counts, done = found(spark, texts)
    assert by_id(done) == wanted(both, texts)
    some = counts.collect()
    assert all(r.pair == r.a << 32 | r.b for r in some) and len({r.pair for r in some}) == len(some)
    assert by_id(found(spark, texts, text=False)[1]) == [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in wanted(both, texts)]


def test_no_rows_and_clashing_names(spark, none, docs, rows):
    for d, n in ((none, 0), (docs.select("*", *[F.lit(1).alias(c) for c in ("pair", "links", "ids", "n_a", "groups")]), len(rows))):
        blocks = alignment.align(d)
        assert alignment.per_document(blocks, alignment.pair_counts(blocks)).count() == n
