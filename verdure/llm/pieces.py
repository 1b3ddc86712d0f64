"""Operator 12: SentencePiece encoding and decoding by vectorised merge rounds.

A BPE model joins, again and again, the neighbouring pair whose joined piece has the best score, leftmost first. Nothing
can be joined across two characters that stand side by side in no piece, so a text falls apart there into words, each of
which is merged by itself. All new words of a slice are one flat array of symbols. A round takes the least pair rank of
each word (a segmented minimum), joins the word's leftmost pair of that rank and those after it for as long as no join
makes a pair that would come first, and closes the gaps; words without a pair leave the array. Rounds end when it is empty.
A worker keeps the ids of words it has met. Decoding gathers the bytes of all pieces at once. Nothing is shuffled.

Models: BPE without user-defined or unused pieces (an unused piece is an error), byte fallback or not.

Defined results: a null text is an empty text, which has the begin and end ids alone and decodes to an empty text; repeated
rows and null ids are encoded like any row; an empty table gives no rows; a long text is read a stretch of words at a time.
Ids that no text encodes to are decoded too: bytes that aren't UTF-8 give U+FFFD each.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm import common
from verdure.llm.tokens import public_path

SPACE = "▁"
#: Stands for no pair; ranks are below.
NONE = np.iinfo(np.int32).max
#: Distinct words kept by a worker, and ids of theirs; then it starts afresh.
MEMO_WORDS, MEMO_IDS = 1 << 19, 1 << 22
#: Characters of a text worked on at once.
STRETCH = 1 << 20

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class _Codes(dict):
    """word -> code; a new word gets the next code and waits in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class PieceModel:
    """encode() and decode() give what the sentencepiece library's encode and decode of this model file give."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: unused pieces are not supported")
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        plain = {text[i]: i for i in range(n) if not (byte[i] or sp.is_control(i) or sp.is_unknown(i))}
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32) if any(byte) else None
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)  # a character without a piece is a symbol of its own
        for p, i in plain.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        worth = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-worth, return_inverse=True)[1].astype(np.int32)
        pairs, beside = {}, set()
        for p, i in plain.items():
            beside.update(map("".join, zip(p, p[1:], strict=False)))
            for k in range(1, len(p)):
                left, right = (int(self.of_char[ord(x)]) if len(x) == 1 else plain.get(x, -1) for x in (p[:k], p[k:]))
                if left >= 0 and right >= 0:
                    pairs[left << 32 | right] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.pair.tolist()], np.int32)
        self.beside = np.array(sorted(ord(a) << 32 | ord(b) for a, b in beside), np.int64)
        inner = any(a != SPACE and b == SPACE for a, b in beside)
        self.words = re.compile(".+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)
        self.breaks = None if inner else re.compile(f"(?<=[^{SPACE}]){SPACE}")
        self.bytes_of = [bytes([int(t[3:5], 16)]) if b else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else t.replace(SPACE, " ").encode() for i, (t, b) in enumerate(zip(text, byte, strict=True))]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.n_bytes = np.array([len(x) for x in self.bytes_of], np.int64)
        self.at = np.cumsum(self.n_bytes) - self.n_bytes
        self.starts_open = np.array([t.startswith(SPACE) for t in text])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.prefixed = sp.normalize("a").startswith(SPACE)
        self.clear()

    def clear(self) -> None:
        self.memo = _Codes()
        self.start, self.length, self.ids, self.n_ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(joined piece, its rank) of each pair of symbols; rank NONE where they can't be joined."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        new = self.joined[at]
        return new, np.where(self.pair[at] == key, self.rank[new], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, the number of each word's symbols) once no pair is left in any word."""
        sizes = np.array([len(w) for w in words], np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        if not n:
            return np.empty(0, np.int32), sizes
        first = np.zeros(n, bool)
        first[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True
        first[0] = True
        key = chars[:-1] << 32 | chars[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        first[1:] |= self.beside[at] != key
        out, left_over = np.zeros(n, np.int32), np.zeros(n, bool)
        sym, pos = self.of_char[chars], np.arange(n)
        starts = np.flatnonzero(first)
        lens = np.diff(np.append(starts, n))
        rank = np.full(n, NONE, np.int32)
        inside = np.flatnonzero(~first[1:])
        rank[inside] = self._pairs(sym[inside], sym[inside + 1])[1]
        while len(sym):
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                stay = np.repeat(live, lens)
                out[pos[~stay]], left_over[pos[~stay]] = sym[~stay], True
                sym, pos, rank, lens, low = sym[stay], pos[stay], rank[stay], lens[live], low[live]
                starts = np.cumsum(lens) - lens
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, lens))
            run = np.concatenate([[True], np.diff(at) > 1])  # of pairs that overlap, each second one
            at = at[(np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            word = np.searchsorted(starts, at, side="right") - 1
            new, now = self._pairs(sym[at], sym[at + 1])
            # What each join puts beside its neighbours; a join that makes a pair of this rank or better is the last of its word in this round.
            soon = np.full(len(at), NONE, np.int32)
            has = at > starts[word]
            before = sym[np.maximum(at - 1, 0)]
            touch = np.flatnonzero(np.diff(at) == 2) + 1
            before[touch] = new[touch - 1]
            soon[has] = self._pairs(before[has], new[has])[1]
            has = at + 2 < starts[word] + lens[word]
            soon[has] = np.minimum(soon[has], self._pairs(new[has], sym[at[has] + 2])[1])
            stops = np.cumsum(soon <= now) - (soon <= now)
            head = np.concatenate([[True], np.diff(word) > 0])
            do = stops == stops[head][np.cumsum(head) - 1]
            at, word, new = at[do], word[do], new[do]
            sym[at] = new
            gone = np.zeros(len(sym) + 1, np.int64)
            gone[at + 2] = 1
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, pos, rank = sym[stay], pos[stay], rank[stay]
            at = at - np.cumsum(gone)[at]
            lens -= np.bincount(word, minlength=len(lens))
            starts = np.cumsum(lens) - lens
            ends = starts[word] + lens[word]
            again = np.zeros(len(sym), bool)
            again[at] = again[at[at > starts[word]] - 1] = True
            again[starts[1:] - 1] = again[-1] = False
            rank[at[at + 1 == ends]] = NONE
            again = np.flatnonzero(again)
            rank[again] = self._pairs(sym[again], sym[again + 1])[1]
        total = np.concatenate([[0], np.cumsum(left_over)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return out[left_over], np.diff(total[edges])

    def _expand(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters without a piece are their bytes' ids, or the unknown id."""
        odd = sym >= self.size
        if not odd.any():
            return sym, counts
        if self.byte_ids is None:
            return np.where(odd, self.unknown, sym), counts
        chars = sym[odd] - self.size
        n = np.ones(len(sym), np.int64)
        n[odd] += (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        out = np.repeat(sym, n)
        out[np.repeat(odd, n)] = self.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)]
        total = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(total[np.concatenate([[0], np.cumsum(counts)])])

    def _learn(self, words: list[str]) -> None:
        ids, counts = self._expand(*self.merge(words))
        base, n = len(self.memo) - len(words), len(words)
        if base + n > len(self.start):
            more = max(len(self.start), n)
            self.start, self.length = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.start, self.length))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        self.length[base : base + n] = counts
        self.start[base : base + n] = self.n_ids + np.cumsum(counts) - counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while self.breaks and len(text) - at > STRETCH and (m := self.breaks.search(text, at + STRETCH)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of normalised texts."""
        if len(self.memo) > MEMO_WORDS or self.n_ids > MEMO_IDS:
            self.clear()
        words = [self.words.findall(t) for t in texts]
        sizes = [len(x) for x in words]
        codes = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        if self.memo.new:
            self._learn(self.memo.new)
            self.memo.new = []
        lens = self.length[codes]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.ids[np.repeat(self.start[codes] - ends[:-1], lens) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])

    def encode(self, texts: list[str], ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, the number of each text's ids); ends: with begin and end ids."""
        normal = self.sp.normalize(texts)
        parts = [(k, x) for k, t in enumerate(normal) for x in self._stretches(t)]
        owner, texts_at = np.array([k for k, _ in parts], np.int64), np.cumsum([len(x) for _, x in parts]) // STRETCH
        edges = np.concatenate([[0], np.flatnonzero(np.diff(texts_at)) + 1, [len(parts)]]).tolist()
        got = [self._some([x for _, x in parts[a:b]]) for a, b in zip(edges, edges[1:], strict=False) if a < b]
        ids = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.int32)
        counts = np.bincount(owner, weights=np.concatenate([c for _, c in got]), minlength=len(texts)).astype(np.int64) if got else np.empty(0, np.int64)
        if not ends:
            return ids, counts
        at = np.cumsum(counts)
        return np.insert(ids, np.stack([at - counts, at], 1).ravel(), np.tile([self.begin, self.end], len(texts))), counts + 2

    def bytes_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces one after the other, the number of each piece's bytes)."""
        n = self.n_bytes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of lists of ids that stand one after the other, of these lengths."""
        flat, n = self.bytes_all(ids)
        ends = np.concatenate([[0], np.cumsum(n)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        lo, hi = ends[edges[:-1]], ends[edges[1:]]
        if self.prefixed:  # the space put before a text goes again
            loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
            first = loud[np.searchsorted(loud, edges[:-1])]
            opened = np.append(self.starts_open[ids], False)[first] & (first < edges[1:])
            lo = lo + opened
        data = flat.tobytes()
        out = [data[a:b].decode("utf-8", "each_byte") for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        # A control piece parts the bytes on its two sides; only inside a text, so hardly ever.
        parts = np.flatnonzero(self.silent[ids])
        where = ends[parts]
        doc = np.searchsorted(edges, parts, side="right") - 1
        inner = (where > lo[doc]) & (where < hi[doc])
        for k in np.unique(doc[inner]).tolist():
            cuts = [lo[k], *where[inner & (doc == k)].tolist(), hi[k]]
            out[k] = "".join(data[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:], strict=False))
        return out


_LOADED: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """One a worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_file: str | None = None, ends: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids are packed, four bytes each, lowest first. model_file: a path that every executor can open, by default the public 32k model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file or public_path("piece_bpe_32k.model"))
        for names, texts, _ in common.slices(batches):
            ids, counts = model.encode(texts, ends)
            at = np.concatenate([[0], np.cumsum(counts)]) * 4
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([pa.array(names), packed], names=["id", "ids"])

    return common.keyed(docs, id_col, text_col, binary=False).mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """The rows of encoded with a column text: what their packed ids decode to (null: an empty text)."""
    plain = encoded.toDF(*[f"c{k}" for k in range(len(encoded.columns))])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file or public_path("piece_bpe_32k.model"))
        for batch in batches:
            packed = [x.as_py() or b"" for x in batch.column(at)]
            texts = model.decode(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), np.array([len(x) // 4 for x in packed], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    schema = T.StructType([*plain.schema.fields, T.StructField("text", T.StringType())])
    return plain.mapInArrow(run, schema).toDF(*encoded.columns, "text")


def unpacked(ids: str = "ids"):
    """The packed ids as an array, in SQL functions alone."""
    digits = F.hex(F.col(ids))
    word = lambda k: F.conv(F.concat(*[F.substring(digits, k * 8 + at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(F.octet_length(F.col(ids)) > 0, F.transform(F.sequence(F.lit(0), (F.octet_length(F.col(ids)) / 4).cast("int") - 1), word)).otherwise(F.array().cast("array<long>"))


def op12_sentencepiece(spark, sf_dir):
    done = decode(encode(common.table(spark, sf_dir, "documents")))
    return done.select(common.real_id(), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
