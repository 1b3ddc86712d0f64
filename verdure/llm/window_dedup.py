"""Operator 9: substring dedup by Rabin-Karp hashes of every window of words.

Every window of `window` words is hashed (polynomial over 64-bit word hashes). Blocks of documents send their
distinct window hashes, Spark tasks count in how many blocks each occurs, and a window is repeated if an
earlier block holds it or an earlier document of its own block does. Repeated windows merge into maximal
intervals of words, which are removed.

Two different windows are taken for equal with a chance of 2^-64 a pair.

Defined results: a null text has no words; texts shorter than a window lose nothing; documents of equal id
(repeated rows) don't count as earlier than each other; a null id is the smallest; an empty table gives no
rows. Words are cut at white space of ASCII alone and kept words are joined by one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import blocks, common

WINDOW, WIDTH = 13, 7
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "id long, n long, n_removed long, spans array<struct<start: long, end: long>>, kept string"


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHash()


def windows(texts: list[bytes], window: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """(words, word count of each text, place of each window in the texts' words one after the other, hash of each window)."""
    if len(_HASHES) > 1 << 18:
        _HASHES.clear()
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((h for ws in words for h in map(_HASHES.__getitem__, ws)), np.uint64, int(counts.sum()))
    n = len(flat) - window + 1
    if n < 1:
        return words, counts, np.empty(0, np.int64), np.empty(0, np.uint64)
    h = flat[:n].copy()
    for j in range(1, window):
        h *= BASE
        h += flat[j : j + n]
    room = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n)
    at = np.flatnonzero(room >= window)
    return words, counts, at, blocks.mixed(h[at]) >> np.uint64(64 - 8 * (1 + WIDTH))


def _block(table: pa.Table, window: int):
    ids, packed = blocks.opened(table)
    return ids, *windows(blocks.unpack(packed), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA: number of words, of words removed, the intervals of words removed, and the words kept, joined by a space."""

    def send(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        *_, h = _block(table, window)
        yield blocks.cells(block, np.unique(h), WIDTH, bits)

    def finish(block: int, table: pa.Table, told: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, words, counts, at, h = _block(table, window)
        names, first, back = np.unique(h, return_index=True, return_inverse=True)
        doc = np.repeat(np.arange(len(ids)), counts)
        earlier = blocks.marked(names, WIDTH, told.column("bucket").to_pylist(), told.column("hits").to_pylist(), bits)
        hit = earlier[back] | (ids[doc[at]] > ids[doc[at[first]]][back]) if len(h) else np.empty(0, bool)
        cover = np.zeros(len(doc) + 1, np.int64)
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        starts = np.cumsum(counts) - counts
        removed = np.bincount(doc[gone], minlength=len(ids))
        kept = []
        for k, ws in enumerate(words):
            left = ws if not removed[k] else [w for w, g in zip(ws, gone[starts[k] : starts[k] + counts[k]].tolist(), strict=True) if not g]
            kept.append(b" ".join(left))
        yield blocks.result(ids, counts, removed, _spans(gone, starts, counts), kept, text=True)

    n = blocks.count(docs, text_col)
    bits, dealt = blocks.bucket_bits(n), blocks.deal(docs, id_col, text_col, n)
    told = blocks.replies(blocks.each_block(dealt, send, blocks.CELL), dealt.order)
    return blocks.each_block_with(dealt, told, finish, SCHEMA)


def _spans(gone: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    some = np.flatnonzero(counts)
    doc, lo, hi = blocks.runs(gone, starts[some])
    return some[doc], lo, hi


def op9_substring_dedup(spark, sf_dir):
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    return found.select(common.real_id(), F.col("n").alias("n_words"), "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
