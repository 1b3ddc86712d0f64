"""Operator 4: WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a bundle ends with a seek table (a
skippable frame of each frame's packed and open size). The index maps a record's id to bundle, frame and
offset within the opened frame, so one record costs one frame. Of pages with equal payloads the one with the
largest id is a response record, the others revisit it and carry no payload.

Payload digests are grouped without the payloads; each payload crosses the network once, packed. A task
writes its bundles as a stream under names of its own; only bundles named in the written index are read.

Defined results: a null payload is empty, a null url is empty; a null id is the smallest; rows that repeat
the largest id and its payload are all responses; payloads shorter than min_bytes are never revisits; an
empty table gives no bundles.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
SKIP_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id long, bundle string, frame int, offset long, length long"
RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record(page: int, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; refers_to: the page a revisit refers to."""
    name = lambda p: f"<urn:page:{'null' if p == common.NULL_ID else p}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", *([] if refers_to is None else [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC headers, HTTP headers, body, place after the record)."""

    def headers(lo: int) -> tuple[dict[str, str], int]:
        hi = data.index(b"\r\n\r\n", lo)
        lines = data[lo:hi].decode().split("\r\n")[1:]
        return dict(x.split(": ", 1) for x in lines if ": " in x) | {x[:-1]: "" for x in lines if x.endswith(":")}, hi + 4

    warc, body = headers(at)
    end = body + int(warc["Content-Length"])
    http, payload = headers(body)
    return warc, http, data[payload:end], end + 4


class BundleWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.press = out, zstandard.ZstdCompressor(level=level)
        self.sizes: list[tuple[int, int]] = []
        self.open, self.size, self.bytes = [], 0, 0

    def add(self, data: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[int, int]:
        """(frame, offset) of the record."""
        if self.size and self.size + len(data) > frame_bytes:
            self.flush()
        at = len(self.sizes), self.size
        self.open.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.size:
            packed = self.press.compress(b"".join(self.open))
            self.out.write(packed)
            self.sizes.append((len(packed), self.size))
            self.bytes += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_MAGIC, len(table)) + table)


class BundleReader:
    """Frames of a bundle by number, from its seek table."""

    def __init__(self, file):
        self.file, size = file, file.size()
        n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        sizes = np.frombuffer(file.read_at(8 * n, size - 9 - 8 * n), "<u4").reshape(-1, 2).astype(np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes[:, 0]) - sizes[:, 0]

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, k: int) -> bytes:
        packed = self.file.read_at(int(self.sizes[k, 0]), int(self.starts[k]))
        return zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes[k, 1]))


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record, by what the index says of it."""
    fs, _ = common.pyarrow_fs(folder)
    with fs.open_input_file(bundle) as file:
        return parse(BundleReader(file).frame(frame)[offset : offset + length])[:3]


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write all pages; returns the index (INDEX), kept in the shared folder."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("text"))
    last = rows.groupBy(F.sha1("text").alias("digest")).agg(F.max("id").alias("last"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for ids, texts, part in common.slices(batches):
            cols = [part.column(0), part.column(1), pa.array([hashlib.sha1(t).hexdigest() for t in texts]), pa.array([press.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "digest", "text"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.pyarrow_fs(folder)
        unpress, writer, held = zstandard.ZstdDecompressor(), None, []

        def close():
            nonlocal writer
            writer.close()
            writer.out.close()
            fs.move(path + ".part", path)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "bundle", "frame", "offset", "length"])
            held.clear()
            writer = None
            return out

        for batch in batches:
            for page, url, digest, packed, best in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(path + ".part"))
                payload = unpress.decompress(packed)
                data = record(page, url, payload, base32(digest), best if best != page and len(payload) >= min_bytes else None)
                held.append((page, path, *writer.add(data, frame_bytes), len(data)))
                if writer.bytes >= bundle_bytes:
                    yield close()
        if writer:
            yield close()

    packed = rows.mapInArrow(pack, "id long, url string, digest string, text binary")
    return common.cut(packed.join(last, "digest").select("id", "url", "digest", "text", "last").mapInArrow(write, INDEX), "warc-index")


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """RECORD of every record in the index's bundles, from the files alone; a response's digest is worked out again and must agree."""

    def page(name: str) -> int | None:
        got = name.removeprefix("<urn:page:").removesuffix(">")
        return None if got == "null" else int(got)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = common.pyarrow_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    bundle = BundleReader(file)
                    for k in range(len(bundle)):
                        data, at, out = bundle.frame(k), 0, []
                        while at < len(data):
                            warc, http, body, at = parse(data, at)
                            kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and base32(hashlib.sha1(body).hexdigest()) != digest:
                                raise ValueError(f"{path}: {warc['WARC-Record-ID']} is damaged")
                            out.append((page(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, page(warc["WARC-Refers-To"]) if kind == "revisit" else None, warc["WARC-Target-URI"]))
                        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])

    n = common.default_parts(index.sparkSession)
    return index.select("bundle").distinct().repartition(n, "bundle").mapInArrow(read, RECORD)


def op4_warc(spark, sf_dir):
    folder = common.fresh(spark, "warc")
    found = read_archive(write_archive(common.table(spark, sf_dir, "pages"), folder), folder)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * k + 1)::INT, 5))::INT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM h
"""
