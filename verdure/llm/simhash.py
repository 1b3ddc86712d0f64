"""Operator 1: SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in 3 bits or fewer share at least 5 of their 8 positional bytes. Those 5
fall on the two halves of 4 positions so that one half shares 3 or more, so it is enough to index the 8
triples of positions that lie in one half: a posting list holds the fingerprints equal in 3 named bytes
(24 bits, so lists stay short where single bytes' lists would hold 1/256 of everything). Within a list the
shared positional bytes of a pair are tallied, pairs with 5 or more are kept, and their bits are compared.

Equal fingerprints are one entry from the start. A list longer than LIST entries is cut into chunks and each
pair of chunks is a piece of work of its own; of the links found in a piece only a spanning forest is
written, so no group is gathered in one task and its pairs are never all written.

Defined results: a text without words (null and empty too) has fingerprint 0, linked like any other; a row
with a null id counts as the smallest id (a component that holds one has component_id null); repeated rows
are linked like copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common
from verdure.llm.components import components

SEED, SHINGLE, BITS, LIST = 42, 3, 3, 1024
TRIPLES = [(a, b, c) for half in (range(4), range(4, 8)) for a in half for b in half for c in half if a < b < c]
ENOUGH = 8 - BITS


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; each bit as in more than half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    grams = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        set_in += np.unpackbits(h[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): fp the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in common.slices(batches):
            fp = np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(fp)], names=["id", "fp"])

    return common.keyed(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def fingerprint_of(text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED):
    """The fingerprint of a text column, bits as a signed long: for rows that no id tells apart."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64).view(np.int64))

    return run(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def _linked(x: np.ndarray, bits: int) -> np.ndarray:
    """Of differences x: which pairs share bytes enough and then differ in few enough bits."""
    out = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def _forest(fp: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among fp."""
    rest, a, b = np.arange(len(fp)), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _linked(fp[rest] ^ fp[at], bits)
            if near.any():
                found = rest[near].tolist()
                rest = rest[~near]
                queue += found
                a += [at] * len(found)
                b += found
    return a, b


def links(entries: DataFrame, bits: int = BITS, list_size: int = LIST) -> DataFrame:
    """(a, b): links between the nodes of entries (fp, node) whose distinct fingerprints differ in `bits` bits or fewer (bits <= 3); enough of them to join every component."""
    if not 0 <= bits <= 3:
        raise ValueError("the index answers for 0 to 3 differing bits")
    spark = entries.sparkSession
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [byte(a) * 65536 + byte(b) * 256 + byte(c) + F.lit(k << 24) for k, (a, b, c) in enumerate(TRIPLES)]
    postings = entries.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    long = postings.groupBy("key").agg(F.ceil(F.count("*") / list_size).cast("int").alias("k")).where("k > 1")
    dealt = postings.join(long, "key", "left").select("key", "fp", "node", F.coalesce("k", F.lit(1)).alias("k"))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pieces = dealt.select("key", F.least("c", "d").alias("lo"), F.greatest("c", "d").alias("hi"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 5

        def pairs(cols: list[np.ndarray]):
            key, lo, hi, fp, node = cols
            fp = fp.view(np.uint64)
            same = (key[1:] == key[:-1]) & (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1])
            run_id = np.concatenate([[0], np.cumsum(~same)])
            size = np.bincount(run_id)
            first = np.cumsum(size) - size
            a, b = [], []
            for r in np.flatnonzero(size > 32).tolist():
                s = slice(first[r], first[r] + size[r])
                x, y = _forest(fp[s], bits)
                a.append(node[s][x])
                b.append(node[s][y])
            small = np.flatnonzero((size[run_id] > 1) & (size[run_id] <= 32))
            for step in range(1, 32):
                i = small[(small + step < len(fp))]
                i = i[run_id[i] == run_id[i + step]]
                if not len(i):
                    break
                i = i[_linked(fp[i] ^ fp[i + step], bits)]
                a.append(node[i])
                b.append(node[i + step])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            n = len(cols[0])
            if not n:
                continue
            at = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            to = int(at[-1]) + 1 if len(at) else 0
            if to:
                yield from pairs([c[:to] for c in cols])
            held = [c[to:] for c in cols]
        if len(held[0]):
            yield from pairs(held)

    n = common.default_parts(spark)
    order = ["key", "lo", "hi"]
    return pieces.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links. The fingerprints are kept in the shared folder, so texts are read once."""
    marks = common.cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    entries = marks.groupBy("fp").agg(F.min("id").alias("node"))
    roots = components(links(entries, bits))
    classes = entries.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"))
    return marks.join(classes, "fp")


def op1_simhash(spark, sf_dir):
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(common.real_id(), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), common.real_id("component", "component_id"))
