"""Finding what repeats across documents without sending documents around twice.

Documents are dealt into blocks, ranges of ascending ids, once; every pass over them reads that one
exchange again. An id that many rows share (null too) is dealt over several blocks of the same order. A pass names pieces of text by 64-bit hashes; a block sends each distinct name once, as
sorted, packed cells (one a bucket of names), and gets back a bit a name in the same order. A name held by
a third of all documents so costs one entry a block, and the largest thing in one task is a block's text or
a bucket's names, both of a size set by the number of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm import common

#: Documents in a block at most, and bytes of text, on average.
BLOCK_ROWS, BLOCK_BYTES = 5_000, 16 << 20
CELL = "block int, bucket int, n int, width int, names binary"
REPLY = "block int, bucket int, hits binary"


class Dealt:
    """Dealt documents: df (block, id, text), text packed, partitioned by block; order: of each block, see common.order_of."""

    def __init__(self, df: DataFrame, order: np.ndarray):
        self.df, self.order = df, order


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, carry: Column | None = None) -> Dealt:
    """All documents; a block of smaller order holds smaller ids only. carry: a column that goes along with each."""
    n = blocks or count(docs, text_col)
    bounds = common.id_bounds(docs, n, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for ids, texts, part in common.slices(batches):
            block = common.spread(bounds, ids, np.array([zlib.crc32(t) for t in texts], np.int64))
            more = part.columns[2:]
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids), pa.array([press.compress(t) for t in texts], pa.binary()), *more], names=["block", "id", "text", "carry"][: 3 + len(more)])

    rows = common.keyed(docs, id_col, text_col, carry=carry)
    return Dealt(rows.mapInArrow(run, common.with_carry("block int, id long, text binary", rows)).repartition(n, "block"), common.order_of(bounds))


def count(docs: DataFrame, text_col: str = "text") -> int:
    """How many blocks: as many as there are shuffle partitions, more if those would be large."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    return max(common.default_parts(docs.sparkSession), -(-size.rows // BLOCK_ROWS), -(-(size.bytes or 0) // BLOCK_BYTES))


def bucket_bits(n_blocks: int) -> int:
    """log2 of the number of buckets of names: 64 at least, and one for 4 blocks or fewer, so that a bucket holds no more than a few blocks' names."""
    return min(24, max(6, (n_blocks - 1).bit_length() - 2))


def _edges(names: np.ndarray, width: int, bits: int) -> np.ndarray:
    return np.searchsorted(names >> np.uint64(8 + 8 * width - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def opened(block: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """A block's ids, ascending, and packed texts."""
    ids = block.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    texts = block.column("text").to_pylist()
    return ids[order], [texts[i] for i in order.tolist()]


def unpack(texts: list[bytes]) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(t) for t in texts]


def cells(block: int, names: np.ndarray, width: int, bits: int = 6) -> pa.RecordBatch:
    """names: ascending, distinct, of 1 + width bytes, of which the first bits are the bucket; sent byte plane by byte plane, so that the leading ones pack to little."""
    press = zstandard.ZstdCompressor(level=1)
    edges = _edges(names, width, bits)
    rows = []
    for k in np.flatnonzero(np.diff(edges)).tolist():
        part = names[edges[k] : edges[k + 1]]
        planes = np.ascontiguousarray(part.view(np.uint8).reshape(-1, 8)[:, : width + 1].T)
        rows.append((block, k, len(part), width, press.compress(planes.tobytes())))
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "n", "width", "names"])


def replies(sent: DataFrame, order_of: np.ndarray | None = None) -> DataFrame:
    """REPLY of all cells: a bit a name, set where another block holds it too (order_of: where a block of smaller order does)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def judge():
            held.sort(key=lambda r: r[0])
            names = []
            for _, _, n, width, packed in held:
                wide = np.zeros((n, 8), np.uint8)
                wide[:, : width + 1] = np.frombuffer(press.decompress(packed), np.uint8).reshape(width + 1, n).T
                names.append(wide.view("<u8").ravel())
            ends = np.cumsum([len(x) for x in names])
            flat = np.concatenate(names)
            order = np.argsort(flat, kind="stable")  # blocks ascend within a name
            same = flat[order][1:] == flat[order][:-1]
            hit = np.zeros(len(flat), bool)
            if order_of is None:
                hit[order[1:]] = same
                hit[order[:-1]] |= same
            elif same.any():
                new = np.concatenate([[True], ~same])
                rank = np.repeat(order_of[[r[0] for r in held]], [r[2] for r in held])[order]
                hit[order] = rank > rank[new][np.cumsum(new) - 1]
            out = []
            for (block, bucket, n, _, _), end in zip(held, ends.tolist(), strict=True):
                if (bits := hit[end - n : end]).any():
                    out.append((block, bucket, np.packbits(bits).tobytes()))
            held.clear()
            cols = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "hits"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[0][1] != row[1]:
                    yield judge()
                held.append(row)
        if held:
            yield judge()

    n = common.default_parts(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, REPLY)


def marked(names: np.ndarray, width: int, bucket: list[int], hits: list[bytes], bits: int = 6) -> np.ndarray:
    """For each of a block's names (as given to cells) whether its bit came back set."""
    edges = _edges(names, width, bits)
    out = np.zeros(len(names), bool)
    for k, packed in zip(bucket, hits, strict=True):
        a, b = int(edges[k]), int(edges[k + 1])
        out[a:b] = np.unpackbits(np.frombuffer(packed, np.uint8), count=b - a)
    return out


def each_block(dealt: Dealt, work: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(block: pa.Table) -> pa.Table:
        common.tidy()
        return pa.Table.from_batches(list(work(block.column("block")[0].as_py(), block)))

    return dealt.df.groupBy("block").applyInArrow(run, schema)


def each_block_with(dealt: Dealt, told: DataFrame, work: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        common.tidy()
        return pa.Table.from_batches(list(work(block.column("block")[0].as_py(), block, told)))

    return dealt.df.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all 64 bits, one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def result(ids: np.ndarray, n: np.ndarray, removed: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], kept: list[bytes], text: bool) -> pa.RecordBatch:
    """(id, n, n_removed, spans, kept) of documents; spans: (document, start, end) in order."""
    doc, lo, hi = spans
    offsets = np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], names=["start", "end"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.array(kept, pa.binary()).cast(pa.string()) if text else pa.array(kept, pa.binary())], names=["id", "n", "n_removed", "spans", "kept"])


def runs(gone: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within documents that begin at `starts`: (document, start, end) within the document."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    inner = starts[1:][np.searchsorted(lo, starts[1:]) > np.searchsorted(hi, starts[1:], side="right")] if len(lo) else starts[:0]
    lo, hi = np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))
    doc = np.searchsorted(starts, lo, side="right") - 1
    return doc, lo - starts[doc], hi - starts[doc]
