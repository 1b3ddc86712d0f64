import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdure.llm import common, packing, token_output, tokens
from verdure.llm.tokens import WordTokenizer, public_path

ODD = ["", " ", "a  b", "a \n b", "\n\n x  ", "it's a <|endoftext|> b", "é́ Σ ΑΣ", "x\t y", "12 345  ", "foo\n\nbar   baz", "a\x1cb c", "a  b  c", " lead", "trail ", "\x00 \x00x", "a<|endoftext|>b <|startoftext|> c", "don't WE'LL x's 12a3½ ²", "e\u0301 \u0301x ﬁ ǅ İi ẞ", "\xa0a \u2003b\u3000c", "日本 語x。", "-- ... a--b !?x", "\x7f\x01a b\x1f"]


def whole(name):
    return Tokenizer.from_file(public_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_encode_as_whole_texts(name, rows):
    texts = ODD + [t or "" for _, t in rows]
    tok, ref = WordTokenizer(public_path(name)), whole(name)
    for _ in range(2):
        ids, n = tok.encode(texts)
        at = np.concatenate([[0], np.cumsum(n)])
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)
    assert len(tok.encode([])[0]) == 0


def test_a_piece_is_merged_once_and_known_words_are_kept(monkeypatch):
    tok, ref, merged = WordTokenizer(public_path("word_bpe_49k.json")), whole("word_bpe_49k.json"), []

    class Counted:
        def tokenize(self, piece, merge=tok.model.tokenize):
            merged.append(piece)
            return merge(piece)

    monkeypatch.setattr(tok, "model", Counted())
    texts = ["Thinrewh thinrewh, THINREWH. (thinrewh) 'thinrewh'", "thinrewh; Écòle école, ÉCÒLE", "thinrewh! E\u0301co\u0300le. H\u0331x"]
    for t in texts:
        assert tok.encode([t])[0].tolist() == ref.encode(t, add_special_tokens=False).ids
    assert len(merged) == len(set(merged)) and merged.count("thinrewh") == 1


def test_memos_start_afresh(monkeypatch, rows):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 10)
    texts = ODD + [t or "" for _, t in rows]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tok, ref = WordTokenizer(public_path(name)), whole(name)
        for t in texts + texts[::-1]:
            assert tok.encode([t])[0].tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_character_between_letters(name):
    """White space of the tokenizer's file, of Arrow and of Python, characters that normalise to others or that only one side's tables have, marks at a word's start."""
    texts = [f"A{chr(c)}b {chr(c)}c{chr(c)}" for c in [*range(0x3400), *range(0xF900, 0x10000), *range(0x10400, 0x10500), *range(0x1D100, 0x1D200), *range(0x1E900, 0x1E950)]]
    ids, n = WordTokenizer(public_path(name)).encode(texts)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, x in enumerate(whole(name).encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == x.ids, repr(texts[k])


@pytest.mark.parametrize("normalizer", [None, {"type": "Lowercase"}, {"type": "Prepend", "prepend": "x"}])
def test_other_tokenizer_files_are_encoded_whole(tmp_path, normalizer):
    spec = json.load(open(public_path("word_bpe_49k.json"), encoding="utf-8"))
    path = str(tmp_path / "t.json")
    json.dump(spec | {"normalizer": normalizer}, open(path, "w", encoding="utf-8"))
    tok, ref = WordTokenizer(path), Tokenizer.from_file(path)
    ids, n = tok.encode(ODD)
    want = [ref.encode(t, add_special_tokens=False).ids for t in ODD]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 2, 3], [3, 70, 70, 1000, 10**12], [-(2**62), 0, 2**62], list(np.cumsum(np.arange(2000) % 37)), [0] * 300 + [10**9] * 700 + list(range(2 * 10**9, 2 * 10**9 + 700))])
def test_elias_fano(values):
    v = np.array(values, np.int64)
    e = token_output.EliasFano.from_bytes(token_output.EliasFano.of(v).to_bytes())
    assert e.all().tolist() == v.tolist() and [e.select(i) for i in range(len(v))] == v.tolist()
    assert all(e.select(i, j).tolist() == v[i:j].tolist() for i, j in [(0, 0), (0, min(1, len(v))), (len(v) // 3, len(v)), (len(v) // 2, len(v) // 2 + len(v) // 4), (min(255, len(v)), min(513, len(v)))])
    assert all(e.rank(x) == (v <= x).sum() for x in [*v[:: max(1, len(v) // 9)].tolist(), 4, 10**13, -(2**62) - 1])
    with pytest.raises(IndexError):
        e.select(len(v))
    if len(v) == 2000:
        assert len(e.to_bytes()) < len(v) * 2


def test_round_trip_of_shards(spark, docs, rows):
    folder = common.fresh(spark, "t")
    manifest = token_output.write_tokens(docs, folder, shards=5)
    got = sorted(map(tuple, token_output.read_tokens(manifest, folder).collect()), key=lambda r: r[1])
    ref = whole("word_bpe_49k.json")
    ids = sorted(((i is not None, i or 0, [*ref.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows), key=lambda r: r[:2])
    start, seen = 0, []
    for r in got:
        assert r[1] == start
        start += r[2]
        seen.append((r[0] is not None, r[0] or 0, r[2], r[3]))
    assert [s[:2] for s in seen] == [s[:2] for s in ids]
    assert sorted(seen) == sorted((a, b, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, b, x in ids)
    fs, _ = common.pyarrow_fs(folder)
    first = manifest.orderBy("shard").first()
    with fs.open_input_file(first.path) as f:
        shard = token_output.Shard(f)
        assert [len(shard.document(i)) for i in range(shard.n)] == np.diff(shard.ends.all()).tolist()


def check_pieces(pieces, window=2048):
    """Pieces cover documents once and sequences without gaps; returns the padding."""
    docs, seqs = {}, {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    pad = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad


def test_packing(spark, docs, rows):
    pieces = packing.pack(docs).collect()
    assert check_pieces(pieces) == 0
    ref = whole("byte_bpe_50k.json")
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*ref.encode(t or "", add_special_tokens=False).ids, 1])
    got = {}
    for r in pieces:
        got.setdefault((r.doc_id), []).append(r)
    for i, texts in want.items():
        mine = got.pop(i)
        assert sum(r.length for r in mine) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(texts[0]), zlib.crc32(np.array(texts[0][at : at + r.length], "<u4").tobytes()))
                at += r.length
            assert at == len(texts[0])
    assert not got


@pytest.mark.parametrize("lengths", [[], [1], [16], [17, 15, 1], [5] * 40, list(range(1, 70)), [1000, 3, 13, 16, 32]])
def test_plan_covers_lengths(lengths):
    doc, start, length, seq, off = packing.plan(np.array(lengths, np.int64), 16)
    for d, n in enumerate(lengths):
        at = 0
        for k in sorted(np.flatnonzero(doc == d).tolist(), key=lambda k: start[k]):
            assert start[k] == at
            at += length[k]
        assert at == n
    fill = np.bincount(seq, length) if len(seq) else np.empty(0)
    assert all(f == 16 or f in (1, 2, 4, 8) for f in fill) and len(set(zip(seq.tolist(), off.tolist(), strict=True))) == len(seq)


def test_nnls_is_nonnegative_and_fits():
    hist = np.zeros(17, int)
    hist[[3, 5, 8, 11, 13]] = [10, 10, 10, 10, 10]
    combos = packing.combinations(hist, 16)
    x = packing.nnls(combos, hist, 200)
    assert (x >= 0).all() and {tuple(sorted(c)) for c in combos} == {(5, 11), (3, 13), (8, 8), (3, 5, 8)} - ({(3, 5, 8)} if all(len(c) < 3 for c in combos) else set())
    n = packing.repeats(combos, x, hist)
    assert n[[i for i, c in enumerate(combos) if sorted(c) == [5, 11]][0]] > 5


def test_empty(spark, none):
    folder = common.fresh(spark, "t")
    assert token_output.read_tokens(token_output.write_tokens(none, folder), folder).count() == 0 and packing.pack(none).count() == 0
    assert packing.pack(none).select(F.col("sequence_id")).columns == ["sequence_id"]
