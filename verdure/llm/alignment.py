"""Operator 13: the tokens of two tokenizers side by side, and which id of one stands for which of the other.

All texts of a slice are laid end to end on one axis of bytes. The ends of A's and of B's tokens on it are counted per byte
once (two bincounts); where both are there, a group ends in both. Differences of running sums at the documents' borders
give each document's tokens, groups and links. A link is the last A token and the last B token of a group.

A task's documents make blocks of about BLOCK_BYTES. A block sends each distinct id pair once with its count; the counts are
summed over all blocks, compared with the best of their B id, and sent back to the blocks that hold the pair, which add them up per document.
So a pair that ends every third group of the corpus is a row a block, and texts cross the network never, links once. A very
long text is read a stretch at a time, cut at a lone space between two other characters, where both tokenizers cut anyway.

Defined results: a text that is null or empty, or that one of the tokenizers doesn't give back byte for byte, has no tokens
(zeros, and '' for its groups) and counts for no pair; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common
from verdure.llm.pieces import piece_model
from verdure.llm.tokens import byte_letters, public_path, tokenizer

#: Bytes of text and rows of a block, about; characters of a text worked on at once.
BLOCK_BYTES, BLOCK_ROWS, STRETCH = 32 << 20, 100_000, 1 << 20
_BREAK = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


class Side:
    """ids of texts, and the bytes of each id."""

    def __init__(self, encode, pieces: list[bytes]):
        self.encode = encode
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.at = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids one after the other, where each one ends)."""
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache  # one a worker process
def byte_side(path: str) -> Side:
    """A byte-level BPE file; texts get a space before them, and special tokens' strings are plain text."""
    tok = tokenizer(path, plain=True)
    to_byte = {chr(c): b for b, c in byte_letters().items()}
    names = {i: t for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}
    pieces = [bytes(to_byte[c] for c in names[i]) if i in names and all(c in to_byte for c in names[i]) else b"" for i in range(tok.vocab_size)]
    return Side(lambda texts: tok.encode([" " + t for t in texts]), pieces)


@lru_cache
def piece_side(path: str) -> Side:
    model = piece_model(path)
    return Side(model.encode, model.bytes_of)


_DIGITS = np.zeros((1, 1), np.uint8), np.zeros(1, np.int64)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimals of all numbers below n, one a row with room for one more letter, and how many digits each has."""
    global _DIGITS
    if len(_DIGITS[1]) < n:
        width = len(str(n)) + 1
        _DIGITS = np.frombuffer(b"".join(str(i).encode().ljust(width) for i in range(n)), np.uint8).reshape(n, width), np.array([len(str(i)) for i in range(n)])
    return _DIGITS


class Aligned:
    """Of texts laid end to end: ok, n_a, n_b, n_groups of each; a and b of all links; spelled: groups of each text in bytes."""

    def __init__(self, a: Side, b: Side, texts: list[str]):
        want = [b" " + t.encode() if t else b"" for t in texts]
        size = np.array([len(w) for w in want], np.int64)
        self.ok = size > 0
        sides = [(a, *a.encode(texts)), (b, *b.encode(texts))]
        for side, ids, counts in sides:
            total = np.concatenate([[0], np.cumsum(side.size[ids])])
            self.ok &= np.diff(total[np.concatenate([[0], np.cumsum(counts)])]) == size
        kept = []
        for side, ids, counts in sides:
            self._same(want, size, side, ids[np.repeat(self.ok, counts)])
        size, border = np.where(self.ok, size, 0), np.concatenate([[0], np.cumsum(np.where(self.ok, size, 0))])
        for side, ids, counts in sides:
            ids = ids[np.repeat(self.ok, counts)].astype(np.int64)
            ends = np.cumsum(side.size[ids])
            kept.append((ids, ends, np.bincount(ends, minlength=int(border[-1]) + 1)))
        (a_ids, a_ends, a_at), (b_ids, b_ends, b_at) = kept
        both = (a_at > 0) & (b_at > 0)
        upto_a, upto_b, upto = (np.cumsum(x) for x in (a_at, b_at, both))
        self.n_a, self.n_b, self.n_groups = (np.diff(x[border]) for x in (upto_a, upto_b, upto))  # no token ends at byte 0
        cut = np.flatnonzero(both)
        last_a, last_b = upto_a[cut], upto_b[cut]
        self.a, self.b = a_ids[last_a - 1], b_ids[last_b - 1]
        # Both sides in one row of tokens, group by group; the letter after each.
        ids, after = np.empty(len(a_ids) + len(b_ids), np.int64), np.full(len(a_ids) + len(b_ids), ord(","), np.uint8)
        before_b = np.concatenate([[0], last_b])
        ids[np.arange(len(a_ids)) + before_b[upto[a_ends - 1]]] = a_ids
        ids[np.arange(len(b_ids)) + last_a[upto[b_ends - 1]]] = b_ids
        before_b = before_b[:-1]
        after[last_a + before_b - 1] = ord("|")
        after[last_a + last_b - 1] = ord(";")
        table, width = _digits(max(len(a.size), len(b.size)))
        rows, width = table[ids], width[ids]
        rows[np.arange(len(ids)), width] = after
        letters = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        edge = np.concatenate([[0], np.cumsum(width + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        self.spelled = [letters[x : y - 1] if y > x else b"" for x, y in zip(edge, edge[1:], strict=False)]

    def _same(self, want: list[bytes], size: np.ndarray, side: Side, ids: np.ndarray) -> None:
        """Take from ok the texts whose bytes differ (of equal length)."""
        there = np.flatnonzero(self.ok)
        flat, _ = side.spell(ids)
        text = np.frombuffer(b"".join(want[k] for k in there.tolist()), np.uint8)
        off = np.flatnonzero(flat != text) if len(flat) == len(text) else np.empty(0, np.int64)
        if len(off):
            self.ok[there[np.unique(np.searchsorted(np.cumsum(size[there]), off, side="right"))]] = False


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH and (m := _BREAK.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:] if at else text


class _Block:
    """What a task has aligned since the last block."""

    def __init__(self, text: bool):
        self.text = text
        self.ids, self.numbers, self.groups, self.bytes = [], [], [], 0
        self.pairs, self.links = [], []  # distinct pairs of each slice, and the place there of each of its links

    def add(self, ids: np.ndarray, texts: list[str], a: Side, b: Side) -> None:
        parts = [(k, s) for k, t in enumerate(texts) for s in stretches(t)]
        n, ok, linked = np.zeros((len(texts), 3), np.int64), np.ones(len(texts), bool), []
        running: list = [None] * len(texts)
        at = np.cumsum([len(s) for _, s in parts]) // STRETCH
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(parts)]
        for x, y in zip(edges, edges[1:], strict=False):
            got, owner = Aligned(a, b, [s for _, s in parts[x:y]]), np.array([k for k, _ in parts[x:y]], np.int64)
            np.add.at(n, owner, np.stack([got.n_a, got.n_b, got.n_groups], 1))
            ok[owner[~got.ok]] = False
            pairs, place = np.unique(got.a << 32 | got.b, return_inverse=True)
            linked.append((np.repeat(owner, got.n_groups), pairs, place.astype(np.uint32)))
            for k, spelled in zip(owner.tolist(), got.spelled, strict=True):
                if self.text:
                    running[k] = spelled if running[k] is None else running[k] + b";" + spelled
                elif running[k] is None:
                    running[k] = hashlib.sha256(spelled)
                else:
                    running[k].update(b";" + spelled)
        n[~ok] = 0
        self.ids.append(ids)
        self.numbers.append(n)
        self.groups += ["" if not good else r.decode() if self.text else r.hexdigest() for good, r in zip(ok.tolist(), running, strict=True)]
        for owner, pairs, place in linked:  # a text of which one stretch failed has no links
            self.pairs.append(pairs)
            self.links.append(place if ok.all() else place[ok[owner]])
        self.bytes += sum(map(len, texts))

    def row(self, block: int) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(self.pairs)) if self.pairs else np.empty(0, np.int64)
        index = [np.searchsorted(pairs, p).astype(np.uint32)[x] for p, x in zip(self.pairs, self.links, strict=True)]
        index = np.concatenate(index) if index else np.empty(0, np.uint32)
        times = np.bincount(index, minlength=len(pairs))
        if not times.all():
            index, pairs, times = (np.cumsum(times > 0) - 1)[index], pairs[times > 0], times[times > 0]
        press = zstandard.ZstdCompressor(level=1)
        n = np.concatenate(self.numbers)
        cols = [[block], [np.concatenate(self.ids)], [n[:, 0]], [n[:, 1]], [n[:, 2]], [self.groups], [press.compress(index.astype("<u4").tobytes())], [pairs], [times]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, BLOCK.types, strict=True)], names=BLOCK.names)


_LONGS = pa.list_(pa.int64())
BLOCK = pa.schema([("block", pa.int64()), *((c, _LONGS) for c in ("ids", "n_a", "n_b", "n_groups")), ("groups", pa.list_(pa.string())), ("links", pa.binary()), ("pairs", _LONGS), ("times", _LONGS)])


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of aligned documents, written to the shared folder: (block, ids, n_a, n_b, n_groups, groups, links, pairs, times).

    a_file: a byte-level BPE file, b_file: a SentencePiece model. groups: of each document `a1,a2|b1;a3|b2,b3`, as it is (text) or its
    SHA-256; pairs: the distinct links as a * 2^32 + b, ascending; links: a place in pairs for each link of the block, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = byte_side(a_file or public_path("byte_bpe_50k.json")), piece_side(b_file or public_path("piece_bpe_32k.model"))
        number, held = TaskContext.get().partitionId() << 32, _Block(text)
        for ids, texts, _ in common.slices(batches):
            held.add(ids, texts, a, b)
            if held.bytes >= BLOCK_BYTES or sum(map(len, held.ids)) >= BLOCK_ROWS:
                yield held.row(number)
                number, held = number + 1, _Block(text)
        if held.ids:
            yield held.row(number)

    schema = "block long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, links binary, pairs array<long>, times array<long>"
    return common.cut(common.keyed(docs, id_col, text_col, binary=False).mapInArrow(run, schema), "aligned")


def _by_block(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): links of each id pair in the whole corpus, and whether no pair of its B id has more."""
    n = _by_block(blocks).groupBy("pair").agg(F.sum("times").alias("count")).select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count")
    most = n.groupBy("b").agg(F.max("count").alias("most"))
    return n.join(most, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def per_document(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of all documents; the counts of a block's pairs come to the block."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        order = np.argsort(told.column("pair").to_numpy())
        count, best = told.column("count").to_numpy()[order], told.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        get = lambda c: block.column(c)[0].values.to_numpy()
        n = get("n_groups")
        link = np.frombuffer(zstandard.ZstdDecompressor().decompress(block.column("links")[0].as_py()), "<u4")
        edge = np.concatenate([[0], np.cumsum(n)])
        each = [np.diff(np.concatenate([[0], np.cumsum(x[link])])[edge]) for x in (best, count)]
        out = [get("ids"), get("n_a"), get("n_b"), n, n, *each]
        return pa.Table.from_arrays([*(pa.array(c, pa.int64()) for c in out), block.column("groups")[0].values], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    told = _by_block(blocks).select(F.col("block").alias("to"), "pair").join(counts.select("pair", "count", "best"), "pair")
    some = blocks.select("block", "ids", "n_a", "n_b", "n_groups", "groups", "links")
    return some.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", groups string")


def op13_alignment(spark, sf_dir):
    blocks = align(common.table(spark, sf_dir, "documents"))
    found = per_document(blocks, pair_counts(blocks))
    return found.select(common.real_id(), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
