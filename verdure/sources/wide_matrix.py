"""A data source for wide matrix files (genes down, samples across): tasks read ranges of lines, and only the wanted samples' cells are converted."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "wide_matrix"
CELLS, HEADERS = "gene_id string, sample_id string, value double", "path string, pos int, sample_id string"
SCHEMA = pa.schema([("gene_id", pa.string()), ("sample_id", pa.string()), ("value", pa.float64())])
#: Bytes of lines a task reads, and about the cells of a batch it gives back.
RANGE_BYTES, BATCH_CELLS = 16 << 20, 1 << 16
NO_VALUE = ["", "NA", "N/A", "null", "NULL"]


@dataclass
class Lines(InputPartition):
    """The lines of a file that start within [low, high); high None: all (packed files can't be entered midway)."""

    path: str
    low: int
    high: int | None


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    for old, new in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = path.replace(old, new, 1) if path.startswith(old) else path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder besides those whose names start with _ or a dot; empty files are left out."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and f.size and f.base_name[0] not in "_.")


def packed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def header_of(path: str, sep: str) -> list[str]:
    fs, at = _opened(path)
    line = b""
    with fs.open_input_stream(at, compression="detect" if packed(path) else None) as f:
        while b"\n" not in line and (more := f.read(1 << 16)):
            line += more
    first = line.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig")
    return next(csv.reader([first], delimiter=sep), [])


def blocks(part: Lines, size: int = 0) -> Iterator[bytes]:
    """The whole lines of a partition without the header, some RANGE_BYTES at a time."""
    size = size or RANGE_BYTES
    fs, at = _opened(part.path)
    if part.high is None:
        with fs.open_input_stream(at, compression="detect") as f:
            rest, first = b"", True
            while True:
                more = f.read(size)
                rest += more
                if first and (b"\n" in rest or not more):
                    rest, first = rest.partition(b"\n")[2], False
                end = rest.rfind(b"\n") + 1 if more else len(rest)
                if end and not first:
                    yield rest[:end]
                    rest = rest[end:]
                if not more:
                    return
    with fs.open_input_file(at) as f:
        f.seek(max(0, part.low - 1))
        here = _to_line_end(f, max(0, part.low - 1))[1]  # the header, or the end of a line that starts before
        if here >= part.high:
            return
        f.seek(here)
        body = f.read(part.high - here)
        if not body.endswith(b"\n"):
            f.seek(part.high)
            body += _to_line_end(f, part.high)[0]
        if body:
            yield body


def _to_line_end(f, here: int) -> tuple[bytes, int]:
    """What is left of the line at `here`, and where the next starts."""
    out = b""
    while more := f.read(1 << 16):
        cut = more.find(b"\n") + 1
        out += more[:cut] if cut else more
        if cut:
            break
    return out, here + len(out)


def wanted(names: list[str], gene: str | None, drop: list[str], samples: set[str] | None) -> tuple[int, list[int]]:
    """The place of the gene column and those of the samples to read; a sample goes by its column's name up to the first dot."""
    at = names.index(gene) if gene else 0
    return at, [k for k, n in enumerate(names) if k != at and n not in drop and (samples is None or n.split(".")[0] in samples)]


def parsed(body: bytes, n: int, sep: str, at: int, keep: list[int]) -> pa.Table:
    """The gene column and the kept ones, named by place; other columns are passed over unconverted. What is no number is null."""
    read, parse = pacsv.ReadOptions(column_names=[str(k) for k in range(n)], block_size=max(1 << 20, len(body) + 1)), pacsv.ParseOptions(delimiter=sep, newlines_in_values=False)
    convert = lambda kind: pacsv.ConvertOptions(include_columns=[str(k) for k in (at, *keep)], column_types={str(at): pa.string()} | {str(k): kind for k in keep}, null_values=NO_VALUE, strings_can_be_null=kind == pa.string())
    try:
        return pacsv.read_csv(io.BytesIO(body), read, parse, convert(pa.float64()))
    except pa.ArrowInvalid:  # some cell is no number, or a line has another number of cells: the second time that is an error
        text = pacsv.read_csv(io.BytesIO(body), read, parse, convert(pa.string()))
    return pa.table([text.column(0)] + [pa.array([_number(x) for x in text.column(k).to_pylist()], pa.float64()) for k in range(1, text.num_columns)], names=text.column_names)


def _number(x: str | None) -> float | None:
    try:
        return float(x) if x is not None else None
    except ValueError:
        return None


def melted(t: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(gene_id, sample_id, value) of the columns after the first, some at a time."""
    rows, genes = t.num_rows, t.column(0).combine_chunks()
    step = max(1, BATCH_CELLS // max(1, rows))
    for low in range(1, t.num_columns if rows else 0, step):
        cols = range(low, min(low + step, t.num_columns))
        gene = genes.take(pa.array(np.tile(np.arange(rows), len(cols))))
        sample = pa.array([names[k - 1] for k in cols]).take(pa.array(np.repeat(np.arange(len(cols)), rows)))
        value = pa.concat_arrays([c for k in cols for c in t.column(k).chunks])
        yield pa.RecordBatch.from_arrays([gene, sample, value], schema=SCHEMA)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.paths, self.sep, self.gene = json.loads(options["paths"]), options.get("sep", ","), options.get("gene")
        self.drop, self.samples = json.loads(options.get("drop", "[]")), None
        self.headers, self.range = options.get("headers") == "true", int(options.get("range_bytes", RANGE_BYTES))
        if "samples" in options:
            self.samples = set(json.loads(options["samples"]))

    def partitions(self) -> list[Lines]:
        out = []
        for path, size in (f for p in self.paths for f in files_of(p)):
            if self.headers or packed(path):
                out.append(Lines(path, 0, None))
            else:
                out += [Lines(path, k, min(size, k + self.range)) for k in range(0, size, self.range)]
        return out or [Lines("", 0, None)]

    def read(self, part: Lines):
        if not part.path:
            return
        names = header_of(part.path, self.sep)
        if self.headers:
            at, keep = wanted(names, self.gene, self.drop, None)
            yield from ((part.path, k, names[k].split(".")[0]) for k in keep)
            return
        at, keep = wanted(names, self.gene, self.drop, self.samples)
        for body in blocks(part) if keep else ():
            yield from melted(parsed(body, len(names), self.sep, at, keep), [names[k].split(".")[0] for k in keep])


class PushedReader(Reader):
    """Takes sample_id = ... and sample_id IN (...) of a query's WHERE as the samples to read."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sample_id",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.samples = asked if self.samples is None else self.samples & asked
            else:
                yield f


class WideMatrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEADERS if self.options.get("headers") == "true" else CELLS

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown") == "true" else Reader)(self.options)


def scan(spark: SparkSession, paths: str | list[str], sep: str = ",", gene: str | None = None, drop: tuple[str, ...] = (), samples: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(gene_id, sample_id, value) of matrix files or folders of them, each by its own header.

    samples: read these alone. With spark.sql.python.filterPushdown.enabled, `where sample_id = / IN` does the same. Cells that are no number are null; a
    line with too few or many cells is an error, as is a file without the named gene column. A quoted cell may hold separators, not line ends.
    Paths are local or any file system pyarrow opens (hdfs, s3, gs), with the executors' credentials.
    """
    spark.dataSource.register(WideMatrix)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "sep": sep, "drop": json.dumps(list(drop)), "pushdown": push.lower(), "range_bytes": str(range_bytes)}
    options |= {"gene": gene} if gene else {}
    options |= {"samples": json.dumps(list(samples))} if samples is not None else {}
    return spark.read.format(FORMAT).options(**options).load()


def headers(spark: SparkSession, paths: str | list[str], sep: str = ",", gene: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """(path, pos, sample_id) of the sample columns; only first lines are read."""
    spark.dataSource.register(WideMatrix)
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "sep": sep, "drop": json.dumps(list(drop)), "headers": "true"}
    return spark.read.format(FORMAT).options(**options, **({"gene": gene} if gene else {})).load()


def sampled(spark: SparkSession, paths: str | list[str], k: int, seed: int = 0, **how) -> DataFrame:
    """The cells of k samples (fewer if there are fewer), the same for a seed whatever files they stand in: those of the least md5 of seed:sample."""
    few = headers(spark, paths, **how).select("sample_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "sample_id")), "sample_id").limit(k)
    return scan(spark, paths, samples=[x[0] for x in few.collect()], **how)
