"""Shared pieces: tables, shared storage, id blocks, Arrow iteration.

Conventions of every operator here: only the named id and text columns are read, so extra columns
(clashing names too) pass unnoticed; a null text is an empty text; a null id is kept and orders
before every other id; repeated rows are rows of their own unless the operator says otherwise.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.storage import cut, drop_path, fresh, shared_dir, uncut  # noqa: F401

#: Stands for a null id inside the operators.
NULL_ID = -(2**63)
#: Bytes of text handled at once inside a task.
SLICE_BYTES = 1 << 20
#: Rows at most, and bytes about, in an Arrow batch between Spark and a worker; a setting of the session's own stays.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: a batch of long texts stands in the executor twice, and in its worker."""
    for key, most in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, most)


def tidy() -> None:
    """Give back to the system what earlier tasks of this worker freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", binary: bool = True, carry: Column | None = None) -> DataFrame:
    """Columns id (long, NULL_ID for null), text (bytes or string, empty for null) and, if given, carry."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (text.cast("binary") if binary else text).alias("text"), *([] if carry is None else [carry.alias("carry")]))


def with_carry(schema: str, df: DataFrame) -> T.StructType:
    """A schema with the carry column of df, if it has one, at its end."""
    return T.StructType([*T._parse_datatype_string(schema).fields, *(f for f in df.schema if f.name == "carry")])


def real_id(name: str = "id", alias: str = "doc_id"):
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(alias)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, list, pa.RecordBatch]]:
    """(ids, texts, slice) of at most about `most` bytes of text, one document at least."""
    tidy()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(at, to - at)
            yield part.column(part.schema.get_field_index("id")).to_numpy(zero_copy_only=False), part.column(part.schema.get_field_index(text)).to_pylist(), part
            at = to


def hash_share(col, share: float):
    """True for about this share of the values, the same ones every time: bounds what a bounded sample is drawn from."""
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(F.xxhash64(col), 34) < int(share * (1 << 30))


def id_bounds(docs: DataFrame, n: int, id_col: str = "doc_id") -> np.ndarray:
    """n-1 ascending ids that part the table into n ranges of nearly as many rows; null ids count as NULL_ID, and an id that fills several ranges is there several times. One narrow pass; 8 n bytes reach the driver."""
    if n < 2:
        return np.empty(0, np.int64)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    got = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n).alias("q")).first()[0]
    return np.sort(np.asarray(got or [], dtype=np.int64))


def spread(bounds: np.ndarray, ids: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The range of each id, 0 to len(bounds), ascending with the ids. An id that stands in bounds m >= 2 times has m - 1 ranges to itself and its rows are dealt over them by salt."""
    low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, side="right")
    own = high - low - 1
    return np.where(own >= 1, low + 1 + salt % np.maximum(own, 1), low).astype(np.int32)


def order_of(bounds: np.ndarray) -> np.ndarray:
    """For each range the first of those that hold the same id: what is of smaller order has smaller ids only, what is of the same has equal ones or is the same range."""
    out = np.arange(len(bounds) + 1)
    for v, m in zip(*np.unique(bounds, return_counts=True), strict=True):
        if m >= 2:
            p = int(np.searchsorted(bounds, v))
            out[p + 1 : p + m] = p + 1
    return out


def pyarrow_fs(uri: str):
    """(file system, path) of a shared folder, for executors."""
    from pyarrow import fs

    if not re.match(r"\w+://", uri):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def share_array(spark: SparkSession, what: str, a: np.ndarray) -> str:
    """Write a matrix to the shared folder, for shared_array(): unlike a broadcast it takes nothing of the driver's JVM."""
    uri = fresh(spark, what)
    fs, path = pyarrow_fs(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(np.ascontiguousarray(a).data)
    return uri


@functools.lru_cache(1)
def shared_array(uri: str, columns: int) -> np.ndarray:
    """What share_array() wrote, a float32 matrix of so many columns; a worker reads it once and keeps the last one."""
    fs, path = pyarrow_fs(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), np.float32).reshape(-1, columns)


def cut_rows(df: DataFrame) -> Iterator[dict]:
    """The rows of what cut() wrote, one at a time in the order of its files, read by Python alone: for few, large rows, which would stand in the driver's JVM several times."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, root = pyarrow_fs(df._cut_path)
    for path in sorted(x.path for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".parquet")):
        with files.open_input_file(path) as f:
            for batch in pq.ParquetFile(f, buffer_size=1 << 20).iter_batches(1, use_threads=False):
                yield from batch.to_pylist()
