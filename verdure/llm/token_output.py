"""Operator 2: token ids in binary shards with Elias-Fano document boundaries.

A shard file: the ids of its documents one after the other (2 or 4 bytes each, little-endian), Elias-Fano of
the n+1 boundaries, Elias-Fano of the ascending document ids, a footer. select of the boundaries gives a
document's offset from about 2 + log2(ids / documents) bits a document; the reader takes all offsets from it.

Shards are ranges of document ids (bounds from a narrow pass over the ids), so texts are encoded once,
their ids cross the network once, packed, and a shard is written as a stream. Executors write under a name
of their own and rename; only the shards in the written manifest are read. Rows of one id (or none) that fill
several ranges are dealt over several shards.

Defined results: a null text is an empty text (its end id alone); null ids come first; repeated rows are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm import common
from verdure.llm.tokens import public_path, tokenizer

MAGIC = b"TOKSHRD1"
#: Documents read back at once.
READ_DOCS = 1 << 16
_FOOT = struct.Struct("<IIQQQQ8s")  # bytes an id, rows with a null id, documents, ids, bytes of boundaries, bytes of document ids, magic
_EF = struct.Struct("<QQIQ")  # values, first value, low bits, bytes of the high part


class EliasFano:
    """An ascending list of whole numbers: low bits packed, high bits in unary. select answers from the packed form: every
    EVERY-th one's place is marked, and only the stretch from the mark on is looked at."""

    EVERY = 256

    def __init__(self, n: int, first: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.first, self.bits, self.low, self.high = n, first, bits, low, high
        self._marks = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8))
        first = int(values[0])
        v = values.astype(np.int64).view(np.uint64) - np.uint64(first % 2**64)
        span = int(v[-1]) + 1
        bits = max(0, (span // n).bit_length() - 1)
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little") if bits else np.empty(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        line = np.zeros(int(ones[-1]) + 1, np.uint8)
        line[ones] = 1
        return cls(n, first, bits, low, np.packbits(line, bitorder="little"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.first % 2**64, self.bits, len(self.high)) + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, first, bits, size = _EF.unpack_from(data)
        high = np.frombuffer(data, np.uint8, size, _EF.size)
        low = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, _EF.size + size)
        return cls(n, first - (first >> 63 << 64), bits, low, high)

    def _low(self, lo: int, hi: int) -> np.ndarray:
        if not self.bits:
            return np.zeros(hi - lo, np.uint64)
        a, b = lo * self.bits, hi * self.bits
        line = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return (line.reshape(-1, self.bits).astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _mark(self) -> tuple[np.ndarray, np.ndarray]:
        """The byte in which each EVERY-th one stands, and how many ones stand before that byte."""
        if self._marks is None:
            wanted = np.arange(0, self.n, self.EVERY)
            at, seen, before = [], [], 0
            for k in range(0, len(self.high), 1 << 20):
                ends = before + np.cumsum(np.bitwise_count(self.high[k : k + (1 << 20)]), dtype=np.int64)
                some = wanted[(wanted >= before) & (wanted < ends[-1])] if len(ends) else wanted[:0]
                byte = np.searchsorted(ends, some, side="right")
                at.append(k + byte)
                seen.append(np.where(byte > 0, ends[byte - 1], before))
                before = int(ends[-1]) if len(ends) else before
            self._marks = tuple(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (at, seen))
        return self._marks

    def select(self, i: int, to: int | None = None) -> int | np.ndarray:
        """The i-th value; with `to`, the values from the i-th up to it."""
        hi = i + 1 if to is None else to
        if not 0 <= i <= hi <= self.n or (to is None and i == self.n):
            raise IndexError(i)
        if i == hi:
            return np.empty(0, np.int64)
        at, seen = self._mark()
        byte, last = int(at[i // self.EVERY]), (hi - 1) // self.EVERY + 1
        end = int(at[last]) + 1 if last < len(at) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little"))[i - int(seen[i // self.EVERY]) :][: hi - i] + 8 * byte
        v = ((ones - np.arange(i, hi)).astype(np.uint64) << np.uint64(self.bits)) | self._low(i, hi)
        v = (v + np.uint64(self.first % 2**64)).view(np.int64)
        return int(v[0]) if to is None else v

    def rank(self, value: int) -> int:
        """How many values are smaller than or equal to this one, by select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= value else (lo, mid)
        return lo

    def all(self) -> np.ndarray:
        return self.select(0, self.n)


class ShardWriter:
    """Writes a shard to a stream: ids go out as they come, the boundaries and names follow in the end."""

    def __init__(self, out, width: int):
        self.out, self.width, self.names, self.lens, self.size = out, width, array("q"), array("q"), 0

    def add(self, doc_id: int, ids: bytes) -> None:
        """Documents come in ascending order of their ids."""
        self.out.write(ids)
        self.names.append(doc_id)
        self.lens.append(len(ids) // self.width)
        self.size += len(ids)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes)."""
        names, lens = (np.frombuffer(x, np.int64) for x in (self.names, self.lens))
        nulls, n_ids = int((names == common.NULL_ID).sum()), self.size // self.width
        ends = EliasFano.of(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)).to_bytes()
        named = EliasFano.of(names[nulls:]).to_bytes()
        self.out.write(ends + named + _FOOT.pack(self.width, nulls, len(names), n_ids, len(ends), len(named), MAGIC))
        self.out.close()
        return len(names), n_ids, self.size + len(ends) + len(named) + _FOOT.size


class Shard:
    """A shard file opened for reading: packed boundaries and names in memory, ids read where they are asked for."""

    def __init__(self, file):
        self.file, size = file, file.size()
        self.width, self.nulls, self.n, self.n_ids, a, b, magic = _FOOT.unpack(file.read_at(_FOOT.size, size - _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        both = bytes(file.read_at(a + b, size - _FOOT.size - a - b))
        self.ends, self.names = EliasFano.from_bytes(both[:a]), EliasFano.from_bytes(both[a:])

    def doc_ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of documents lo to hi."""
        nulls = max(0, min(hi, self.nulls) - lo)
        return np.concatenate([np.full(nulls, common.NULL_ID), self.names.select(max(0, lo + nulls - self.nulls), hi - self.nulls) if hi > self.nulls else np.empty(0, np.int64)])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the shard from place lo to hi."""
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, lo * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i), self.ends.select(i + 1))


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str | None = None, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; returns the manifest (shard, path, n_docs, n_tokens, bytes, base), kept in the shared folder."""
    spark = docs.sparkSession
    bounds = common.id_bounds(docs, shards or common.default_parts(spark), id_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file or public_path("word_bpe_49k.json"))
        press = zstandard.ZstdCompressor(level=1)
        for doc_ids, texts, _ in common.slices(batches):
            ids, count = tok.encode(texts)
            ids = np.insert(ids, np.cumsum(count), end_id).astype(f"<u{tok.dtype().itemsize}")
            ends = np.cumsum(count + 1)
            cells = [press.compress(ids[a:b]) for a, b in zip((ends - count - 1).tolist(), ends.tolist(), strict=True)]
            shard = common.spread(bounds, doc_ids, np.array([zlib.crc32(c) for c in cells], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(doc_ids), pa.array(cells, pa.binary())], names=["shard", "id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file or public_path("word_bpe_49k.json"))
        unpress = zstandard.ZstdDecompressor()
        fs, root = common.pyarrow_fs(folder)
        manifest = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])
        now = writer = None

        def close() -> pa.RecordBatch:
            n, n_ids, size = writer.close()
            path = f"{root}/shard-{now:08d}.tok"
            fs.move(part, path)
            return pa.RecordBatch.from_pylist([{"shard": now, "path": path, "n_docs": n, "n_tokens": n_ids, "bytes": size}], schema=manifest)

        for batch in batches:
            for shard, doc_id, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if shard != now:
                    if writer:
                        yield close()
                    fs.create_dir(root, recursive=True)
                    now, part = shard, f"{root}/part-{uuid.uuid4().hex}"
                    writer = ShardWriter(fs.open_output_stream(part), tok.dtype().itemsize)
                writer.add(doc_id, unpress.decompress(ids))
        if writer:
            yield close()

    wide = common.keyed(docs, id_col, text_col, binary=False).mapInArrow(encode, "shard int, id long, ids binary")
    placed = wide.repartition(max(len(bounds) + 1, 1), "shard").sortWithinPartitions("shard", "id", "ids")
    manifest = common.cut(placed.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long, bytes long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of the manifest, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.pyarrow_fs(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(path) as file:
                    shard = Shard(file)
                    lo = 0
                    while lo < shard.n:  # about a million ids at a time, and no more documents than that
                        hi = min(shard.n, lo + READ_DOCS, max(lo + 1, shard.ends.rank(shard.ends.select(lo) + (1 << 20)) - 1))
                        ends = shard.ends.select(lo, hi + 1)
                        wide = memoryview(shard.ids(int(ends[0]), int(ends[-1])).astype("<u4").view(np.uint8))
                        at = (4 * (ends - ends[0])).tolist()
                        crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:], strict=False)]
                        d = shard.doc_ids(lo, hi)
                        yield pa.RecordBatch.from_arrays([pa.array(d, mask=d == common.NULL_ID), pa.array(base + ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        lo = hi

    n = common.default_parts(manifest.sparkSession)
    return manifest.select("path", "base").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_output(spark, sf_dir):
    folder = common.fresh(spark, "tokens")
    return read_tokens(write_tokens(common.table(spark, sf_dir, "documents"), folder), folder)
