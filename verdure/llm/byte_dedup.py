"""Operator 3: repeated byte strings by suffix buckets and a difference cover.

Two equal strings of LENGTH bytes at places i and j have a shift d < 21 for which i + d and j + d both lie in
the difference cover {0, 1, 4, 14, 16} modulo 21 (places counted within a document), and the 30 bytes there
are equal too. So the cover sample, about a quarter of all suffixes, is ranked first: each block of
documents sends the names of its sampled 30-byte strings, a bucket of names at a time is sorted, and a name
found in two documents is a shared rank. Only suffixes that reach a shared rank within the cover's shift can
be part of a longer tie; these alone are named to the full LENGTH, dealt into buckets, and sorted one bucket
at a time, which tells each block the strings that an earlier block holds. Exact copies of a whole earlier
document are found by a name of the whole text and take no part.

Ordering all suffixes of all documents at once would need a key for each byte of text, several times the
input on disk; the buckets here order suffixes by name rather than by letters, as only ties matter.
Different strings get one name with a chance of 2^-64 a pair.

Defined results: a null text has no bytes; a text shorter than LENGTH loses nothing; documents of equal id
(repeated rows) don't count as earlier than each other; a null id is the smallest; an empty table gives no
rows. Matches never cross documents and are judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm import blocks, common

LENGTH = 50
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
WIDTH = 7
#: Bytes of text for which the arrays of a byte each are held at once.
PART_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
SCHEMA = "id long, n long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
_LETTERS = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(1 << 20, 1 << (n - 1).bit_length())
            cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(b)))]) for b in (BASE, pow(BASE, -1, 2**64)))
        return cls.up, cls.down


class Part:
    """Some documents' bytes, one after the other, with a prefix hash."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.n = int(self.size.sum())

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)

    @cached_property
    def room(self) -> np.ndarray:
        """Bytes from each place to the end of its document."""
        return np.repeat((self.start + self.size).astype(np.int32), self.size) - np.arange(self.n, dtype=np.int32)

    @cached_property
    def _hash(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _Powers.of(self.n + 1)
        sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_LETTERS[np.frombuffer(b"".join(self.texts), np.uint8)] * up[: self.n], out=sums[1:])
        return sums, down

    def names(self, at: np.ndarray, length: int, width: int) -> np.ndarray:
        sums, down = self._hash
        return blocks.mixed((sums[at + length] - sums[at]) * down[at]) >> np.uint64(56 - 8 * width)

    def sampled(self, length: int) -> np.ndarray:
        place = np.arange(self.n) - self.start[self.doc]
        return np.flatnonzero(_IN_COVER[place % PERIOD] & (self.room >= length))

    def reaching(self, shared: np.ndarray, length: int) -> np.ndarray:
        """Places whose string of `length` holds a shared sample."""
        seen = np.zeros(self.n + PERIOD + 1, np.int32)
        seen[shared + 1] = 1
        np.cumsum(seen, out=seen)
        return np.flatnonzero((seen[PERIOD : PERIOD + self.n] > seen[: self.n]) & (self.room >= length))


def _grouped(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct values ascending, each value's number, first and last place of each)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return s[at], back, order[at], order[np.concatenate([at[1:], [len(s)]]).astype(np.int64) - 1] if len(s) else order


def sampled_width(n_blocks: int) -> int:
    """Bytes of a sampled string's name besides the first: as many as keep chance matches, which cost work and nothing else, below about one in a hundred."""
    return 4 + (n_blocks > 1 << 13) + (n_blocks > 1 << 21)


class _Block:
    """One block's work; every pass builds it again from the text and what it was told so far."""

    def __init__(self, table: pa.Table, told: pa.Table | None, length: int, n_blocks: int):
        self.ids, packed = blocks.opened(table)
        self.texts, self.length = blocks.unpack(packed), length
        self.bits, self.sampled_width = blocks.bucket_bits(n_blocks), sampled_width(n_blocks)
        self.told = {}
        if told is not None:
            for kind, bucket, hits in zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "hits")), strict=True):
                self.told.setdefault(kind, ([], []))
                self.told[kind][0].append(bucket)
                self.told[kind][1].append(hits)

    def _marked(self, kind: int, names: np.ndarray, width: int) -> np.ndarray:
        return blocks.marked(names, width, *self.told.get(kind, ([], [])), self.bits)

    def whole(self) -> tuple[np.ndarray, ...]:
        return _grouped(np.array([xxhash.xxh64_intdigest(t) for t in self.texts], np.uint64))

    def copies(self) -> np.ndarray:
        names, back, first, _ = self.whole()
        return self._marked(0, names, WIDTH)[back] | (self.ids > self.ids[first][back])

    @cached_property
    def groups(self) -> list[np.ndarray]:
        """Numbers of the documents that aren't copies and are long enough, about PART_BYTES of text at a time."""
        lens = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        some = np.flatnonzero(~self.copies() & (lens >= self.length))
        group = np.cumsum(lens[some]) // PART_BYTES
        return [some[group == g] for g in np.unique(group)]

    def part(self, docs: np.ndarray) -> Part:
        return Part([self.texts[k] for k in docs.tolist()])

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(names of all sampled strings, their documents' ids)."""
        k, names, owner = self.length - PERIOD + 1, [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for docs in self.groups:
            p = self.part(docs)
            at = p.sampled(k)
            names.append(p.names(at, k, self.sampled_width))
            owner.append(self.ids[docs][p.doc[at]])
        return np.concatenate(names), np.concatenate(owner)

    def candidates(self) -> Iterator[tuple[np.ndarray, Part, np.ndarray]]:
        """(documents, Part, places) of suffixes that reach a shared rank; one Part is held at a time."""
        k, lo = self.length - PERIOD + 1, 0
        names, owner = self.samples()
        names, back, first, last = _grouped(names)
        shared = (self._marked(1, names, self.sampled_width) | (owner[first] != owner[last]))[back]
        del names, owner, back, first, last
        for docs in self.groups:
            p = self.part(docs)
            at = p.sampled(k)
            yield docs, p, p.reaching(at[shared[lo : lo + len(at)]], self.length)
            lo += len(at)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False, carry: Column | None = None) -> DataFrame:
    """SCHEMA: number of bytes, of bytes removed, the spans removed and the bytes kept, of every document. as_text: kept is a string, without characters of which only a part is left. carry: a column of docs that comes out beside, as carry."""
    if length < 2 * PERIOD:
        raise ValueError(f"strings of {2 * PERIOD} bytes at least")

    n = 2 * blocks.count(docs, text_col)
    bits = blocks.bucket_bits(n)

    def send_whole(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield blocks.cells(block, _Block(table, None, length, n).whole()[0], WIDTH, bits)

    def send_samples(block: int, table: pa.Table, told: pa.Table) -> Iterator[pa.RecordBatch]:
        yield blocks.cells(block, np.unique(_Block(table, told, length, n).samples()[0]), sampled_width(n), bits)

    def send_windows(block: int, table: pa.Table, told: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [p.names(at, length, WIDTH) for _, p, at in _Block(table, told, length, n).candidates()]
        yield blocks.cells(block, np.unique(np.concatenate([np.empty(0, np.uint64), *names])), WIDTH, bits)

    def finish(block: int, table: pa.Table, told: pa.Table) -> Iterator[pa.RecordBatch]:
        b = _Block(table, told, length, n)
        held, names, owner = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for docs, p, at in b.candidates():
            held.append((docs, at.astype(np.int32)))
            names.append(p.names(at, length, WIDTH))
            owner.append(b.ids[docs][p.doc[at]])
        names, back, first, _ = _grouped(np.concatenate(names))
        owner = np.concatenate(owner)
        hit = b._marked(2, names, WIDTH)[back] | (owner > owner[first][back])
        del names, back, first, owner
        size = np.fromiter(map(len, b.texts), np.int64, len(b.texts))
        removed, kept = np.where(b.copies() & (size >= length), size, 0), list(b.texts)
        spans = [(k, 0, removed[k]) for k in np.flatnonzero(removed).tolist()]
        for k, _, _ in spans:
            kept[k] = b""
        lo = 0
        for docs, at in held:
            p = b.part(docs)
            cover = np.zeros(p.n + 1, np.int64)
            found = at[hit[lo : lo + len(at)]]
            lo += len(at)
            np.add.at(cover, found, 1)
            np.add.at(cover, found + length, -1)
            gone = np.cumsum(cover)[:-1] > 0
            count = np.bincount(p.doc[gone], minlength=len(docs))
            removed[docs] = count
            for k in np.flatnonzero(count).tolist():
                s = slice(p.start[k], p.start[k] + p.size[k])
                kept[docs[k]] = np.frombuffer(b.texts[docs[k]], np.uint8)[~gone[s]].tobytes()
            spans += zip(docs[(r := blocks.runs(gone, p.start))[0]].tolist(), r[1].tolist(), r[2].tolist(), strict=True)
        spans.sort()
        cols = np.array(spans, np.int64).reshape(-1, 3)
        if as_text:
            kept = [k.decode(errors="ignore").encode() if removed[i] else k for i, k in enumerate(kept)]
        out = blocks.result(b.ids, size, removed, (cols[:, 0], cols[:, 1], cols[:, 2]), kept, text=as_text)
        if "carry" in table.schema.names:
            out = out.append_column("carry", table.column("carry").combine_chunks().take(pa.array(np.argsort(table.column("id").to_numpy(), kind="stable"))))
        yield out

    def told(sent: DataFrame, kind: int, order: np.ndarray | None) -> DataFrame:
        return blocks.replies(sent, order).select("block", F.lit(kind).alias("kind"), "bucket", "hits")

    dealt = blocks.deal(docs, id_col, text_col, n, carry)
    known = told(blocks.each_block(dealt, send_whole, blocks.CELL), 0, dealt.order)
    ranks = told(blocks.each_block_with(dealt, known, send_samples, blocks.CELL), 1, None)
    known = known.unionByName(ranks)
    known = known.unionByName(told(blocks.each_block_with(dealt, known, send_windows, blocks.CELL), 2, dealt.order))
    return blocks.each_block_with(dealt, known, finish, common.with_carry(SCHEMA.replace("kept binary", "kept string") if as_text else SCHEMA, dealt.df))


def op3_suffix_array(spark, sf_dir):
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select(common.real_id(), F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
