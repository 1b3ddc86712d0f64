"""Operator 10: packing documents into training sequences by non-negative least squares.

A task packs what it reads, a block of about BLOCK_TOKENS tokens at a time, so nothing is shuffled and
memory is bounded by the block. In a block, documents give full windows and one rest each. Shallow
combinations (one to three rests that fill a window exactly) are enumerated from the rests' lengths;
non-negative least squares fits how often each is used to the length histogram; the counts are rounded to
what is there; what is left is laid end to end and cut at window ends. The last window of a block, if it is
not full, is cut at powers of two, which need no padding.

Defined results: a null text is packed as its end token alone; repeated rows and null ids are packed like
any row (null id: doc_id null); an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdure.llm import common
from verdure.llm.tokens import public_path, tokenizer

BLOCK_TOKENS = 8 << 20
#: Ways to fill up tried for each longest rest of three.
TRIPLES = 6
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(hist: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """One to three lengths present in hist that fill the window exactly."""
    there = np.flatnonzero(hist[:window])
    have = set(there.tolist())
    out = [(a, window - a) for a in have if a >= window - a and window - a in have]
    for a in there[there >= (window + 2) // 3].tolist():
        rest, n = window - a, 0
        for b in there[: np.searchsorted(there, min(a, rest - 1), side="right")][::-1].tolist():
            c = rest - b
            if c > b or n >= TRIPLES:
                break
            if c in have:
                out.append((a, b, c))
                n += 1
    return out


def nnls(combos: list[tuple[int, ...]], hist: np.ndarray, sweeps: int = 12) -> np.ndarray:
    """x >= 0 that least-squares fits sum_c x_c * (lengths of c) to hist, by coordinate descent on the residual."""
    left, x = hist.astype(float).tolist(), [0.0] * len(combos)
    use = []
    for c in combos:
        m: dict[int, int] = {}
        for v in c:
            m[v] = m.get(v, 0) + 1
        use.append((list(m.items()), sum(k * k for k in m.values())))
    for _ in range(sweeps):
        moved = 0.0
        for i, (m, norm) in enumerate(use):
            step = max(-x[i], sum(k * left[v] for v, k in m) / norm)
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for v, k in m:
                    left[v] -= k * step
        if moved < 0.05:
            break
    return np.asarray(x)


def repeats(combos: list[tuple[int, ...]], x: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Whole counts near x that hist can pay for; then as many more as it still can."""
    left, out = hist.astype(np.int64).tolist(), np.zeros(len(combos), np.int64)
    for top in (lambda i: round(x[i]), lambda i: 1 << 60):
        for i in np.argsort(-x, kind="stable").tolist():
            c = combos[i]
            n = min(top(i), *(left[v] // c.count(v) for v in c))
            if n > 0:
                out[i] += n
                for v in c:
                    left[v] -= n
    return out


def plan(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of the pieces of documents of these lengths; sequences from 0."""
    full, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), full)
    n = len(doc)
    start = (np.arange(n) - np.repeat(np.cumsum(full) - full, full)) * window
    parts = [(doc, start, np.full(n, window), np.arange(n), np.zeros(n, np.int64))]
    sequence = n
    tails = np.flatnonzero(rest)
    order = tails[np.argsort(rest[tails], kind="stable")]
    hist = np.bincount(rest[tails], minlength=window + 1)
    at = np.concatenate([[0], np.cumsum(hist)])[:-1]
    upto = at + hist
    combos = combinations(hist, window)
    for c, n in zip(combos, repeats(combos, nnls(combos, hist), hist).tolist(), strict=True):
        if n:
            offset = 0
            for v in c:
                d = order[at[v] : at[v] + n]
                at[v] += n
                parts.append((d, full[d] * window, np.full(n, v), np.arange(sequence, sequence + n), np.full(n, offset)))
                offset += v
            sequence += n
    left = np.concatenate([order[a:b] for a, b in zip(at, upto, strict=True) if a < b]) if (at < upto).any() else np.empty(0, np.int64)
    if len(left):
        ends = np.cumsum(rest[left])
        total = int(ends[-1])
        whole, over = divmod(total, window)
        last = [1 << k for k in range(window.bit_length() - 1, -1, -1) if over >> k & 1]
        marks = np.concatenate([np.arange(whole + 1) * window, whole * window + np.cumsum(last)]).astype(np.int64)
        edges = np.unique(np.concatenate([marks, ends, [0]]))
        lo, hi = edges[:-1], edges[1:]
        k = np.searchsorted(ends, lo, side="right")
        s = np.searchsorted(marks, lo, side="right") - 1
        d = left[k]
        parts.append((d, full[d] * window + lo - (ends[k] - rest[d]), hi - lo, sequence + s, lo - marks[s]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))


def _emit(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, window: int, base: int) -> tuple[pa.RecordBatch, int]:
    doc, start, length, sequence, offset = plan(lengths, window)
    order = np.lexsort((start, doc))
    doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
    lo = (np.cumsum(lengths) - lengths)[doc] + start
    crc = np.fromiter((zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(lo.tolist(), (lo + length).tolist(), strict=True)), np.int64, len(lo))
    d = doc_ids[doc]
    cols = [pa.array(d, mask=d == common.NULL_ID), *map(pa.array, (start, length, crc, lengths[doc], base + sequence, offset))]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")]), int(sequence.max()) + 1 if len(sequence) else 0


def pack(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 1, window: int = 2048, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: SCHEMA. sequence_id is the task's number times 2^32 and a count; window is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(tokenizer_file or public_path("byte_bpe_50k.json"))
        base = TaskContext.get().partitionId() << 32
        ids, names, lens, n = [], [], [], 0

        def flush():
            nonlocal base, n
            batch, used = _emit(np.concatenate(ids), np.concatenate(names), np.concatenate(lens), window, base)
            base += used
            for x in (ids, names, lens):
                x.clear()
            n = 0
            return batch

        for doc_ids, texts, _ in common.slices(batches):
            got, count = tok.encode(texts)
            with_end = np.insert(got, np.cumsum(count), end_id)
            ids.append(with_end)
            names.append(doc_ids)
            lens.append(count + 1)
            n += len(with_end)
            if n >= block_tokens:
                yield flush()
        if n:
            yield flush()

    return common.keyed(docs, id_col, text_col, binary=False).mapInArrow(run, SCHEMA)


def op10_packing(spark, sf_dir):
    return pack(common.table(spark, sf_dir, "documents"))
