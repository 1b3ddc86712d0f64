"""Operator 11: fill-in-middle by a parallel automaton scan.

A finite automaton over UTF-8 bytes counts units (code points or words) and markers met. A text is cut into chunks at any
byte; each chunk tells, for every state it might be entered in, the state it is left in and what it counts. These functions
compose associatively, so a segmented scan over the chunks gives each chunk's real entry state and the counts before it.
The k-th unit is then in a known chunk, the only one read again. For ordinary documents all chunks of an Arrow slice are
stepped through side by side and nothing is shuffled. A document of more than GIANT bytes is dealt out in pieces over all
tasks: a task sends a piece's function (a few numbers), the functions of a document are composed, cuts are looked up in the
pieces that hold them, and the output goes on in parts, so that no task holds a giant document; its parts are hashed as a stream.

A document becomes plain (the text), psm (<P>prefix<S>suffix<M>middle) or spm (<S>suffix<P>prefix<M>middle), by a hash of its id.

Defined results: a null text is empty, and an empty text is plain, as is one that holds a marker; a null id is hashed as no
digits; rows that share an id are cut at places drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm import common

MARKERS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a chunk; a document over GIANT bytes is dealt out in pieces of PIECE bytes.
CHUNK, GIANT, PIECE = 256, 1 << 20, 1 << 20
PAD = 256
_SPACE = set(b" \t\n\x0b\x0c\r")


class Automaton:
    """table[state * 257 + byte]: next state, and from bit 8 on whether a unit begins here and from bit 24 on whether a marker ends here. State 0 is the first; PAD changes nothing."""

    def __init__(self, unit: str = "char", markers: tuple[bytes, ...] = MARKERS):
        if unit not in ("char", "word"):
            raise ValueError(f"unit {unit!r}")
        heads = sorted({m[:k] for m in markers for k in range(len(m))} | {b""})
        shown = 2 if unit == "word" else 1  # words: 0 after space, 1 inside
        self.states = shown * len(heads)
        table = np.zeros((self.states, 257), np.uint32)
        for u in range(shown):
            for h, head in enumerate(heads):
                for b in range(256):
                    seen = head + bytes([b])
                    after = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in heads)
                    inside = b not in _SPACE
                    begins = (inside and not u) if unit == "word" else b & 0xC0 != 0x80
                    to = (int(inside) if unit == "word" else 0) * len(heads) + heads.index(after)
                    table[u * len(heads) + h, b] = to | begins << 8 | sum(seen.endswith(m) for m in markers) << 24
                table[u * len(heads) + h, PAD] = u * len(heads) + h
        self.table = table.ravel()

    def functions(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after, counts) of each chunk (a row of bytes, padded) for each entry state; counts[..., 0] units, [..., 1] markers."""
        n = len(chunks)
        state = np.repeat(np.arange(self.states, dtype=np.uint32)[:, None], n, 1)
        count = np.zeros((self.states, n), np.uint32)
        for column in np.ascontiguousarray(chunks.T):
            got = self.table[state * np.uint32(257) + column]
            state = got & np.uint32(255)
            count += got >> np.uint32(8)
        return state.T.astype(np.int64), np.stack([count.T & 0xFFFF, count.T >> 16], -1).astype(np.int64)

    def events(self, chunks: np.ndarray, entry: np.ndarray, field: int, k: np.ndarray) -> np.ndarray:
        """Within each chunk, entered in its state, the byte at which its event number k (from 0) of this field happens."""
        state, left, out = entry.astype(np.uint32), k.astype(np.int64).copy(), np.full(len(chunks), -1)
        for j, column in enumerate(np.ascontiguousarray(chunks.T)):
            got = self.table[state * np.uint32(257) + column]
            state = got & np.uint32(255)
            here = (got >> np.uint32(8 if field == 0 else 24)) & np.uint32(0xFFFF if field == 0 else 255)
            out[(left == 0) & (here > 0)] = j
            left -= here
        return out


def compose(state: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For functions in order, first[i] the place of the first of i's document: the functions of all from the document's first up to each.

    A scan by doubling: after each round a function stands for twice as many of those before it."""
    state, count = state.copy(), count.copy()
    i = np.arange(len(state))
    d, most = 1, int((i - first).max(initial=0))
    while d <= most:
        at = np.flatnonzero(i - d >= first)
        then = state[at - d]
        state[at], count[at] = np.take_along_axis(state[at], then, 1), count[at - d] + np.take_along_axis(count[at], then[..., None], 1)
        d *= 2
    return state, count


def entered(state: np.ndarray, count: np.ndarray, first: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From composed functions and the state each one's document begins in: (entry state of each, counts before it, counts up to its end)."""
    i = np.arange(len(state))
    entry, before, upto = opening.copy(), np.zeros((len(state), 2), np.int64), count[i, opening]
    inner = np.flatnonzero(i > first)
    entry[inner], before[inner] = state[inner - 1, opening[inner]], upto[inner - 1]
    return entry, before, upto


class Scan:
    """Texts, cut into chunks and scanned: function (state, count) of each text, total[i] of each field, and find(i, field, k). opening: the state each text is entered in, 0 by default."""

    def __init__(self, auto: Automaton, texts: list[bytes], opening: np.ndarray | None = None):
        self.auto = auto
        size = np.array([len(t) for t in texts], np.int64)
        self.n = np.maximum(-(-size // CHUNK), 1)
        self.head = np.cumsum(self.n) - self.n
        flat = np.frombuffer(b"".join(texts), np.uint8)
        self.chunks = np.full((int(self.n.sum()), CHUNK), PAD, np.uint16)
        self.chunks.ravel()[np.arange(len(flat)) + np.repeat(self.head * CHUNK - (np.cumsum(size) - size), size)] = flat
        first = np.repeat(self.head, self.n)
        state, count = compose(*auto.functions(self.chunks), first)
        last = self.head + self.n - 1
        self.function = state[last], count[last]
        opening = np.zeros(len(texts), np.int64) if opening is None else opening
        self.entry, self.before, upto = entered(state, count, first, np.repeat(opening, self.n))
        self.total = upto[last]

    def find(self, doc: np.ndarray, field: int, k: np.ndarray) -> np.ndarray:
        """The byte at which event k (less than the total) of this field happens in each document."""
        lo, hi = self.head[doc], self.head[doc] + self.n[doc] - 1  # the last chunk with at most k before it
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = self.before[mid, field] <= k
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        return (lo - self.head[doc]) * CHUNK + self.auto.events(self.chunks[lo], self.entry[lo], field, k - self.before[lo, field])


@dataclass
class Choice:
    """How documents are cut: the hashed text is `seed`:id; out of 100, plain_pct stay plain, spm_pct of the others are spm."""

    seed: int = 1
    plain_pct: int = 10
    spm_pct: int = 20
    unit: str = "char"

    def hashes(self, name: str = "id") -> list[Column]:
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.when(F.col(name) != common.NULL_ID, F.col(name).cast("string")).otherwise("")), 256)
        return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def forms(self, total: np.ndarray, size: np.ndarray, h: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(form, units up to the first cut, units up to the second)."""
        n = total[:, 0]
        a, b = h[0] % (n + 1), h[1] % (n + 1)
        plain = (size == 0) | (total[:, 1] > 0) | (h[2] % 100 >= 100 - self.plain_pct)
        return np.where(plain, "plain", np.where(h[3] % 100 < self.spm_pct, "spm", "psm")), np.minimum(a, b), np.maximum(a, b)


def _arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def _counts(form: np.ndarray, *cuts: np.ndarray) -> list[pa.Array]:
    return [pa.array(c, pa.int64(), mask=form == "plain") for c in cuts]


COLUMNS = "id long, n long, form string, prefix_units long, middle_units long"


def transform_ordinary(rows: DataFrame, choice: Choice) -> DataFrame:
    """(id, n, form, prefix_units, middle_units, output) of rows (id, text in bytes), each text within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(choice.unit)
        for ids, texts, part in common.slices(batches):
            h = [part.column(k).to_numpy() for k in range(2, 6)]
            scan = Scan(auto, texts)
            size = np.array([len(t) for t in texts], np.int64)
            form, a, b = choice.forms(scan.total, size, h)
            docs = np.flatnonzero(form != "plain")
            at = []
            for k in (a, b):
                there, inner = size.copy(), docs[(k[docs] > 0) & (k[docs] < scan.total[docs, 0])]
                there[k == 0] = 0
                there[inner] = scan.find(inner, 0, k[inner])
                at.append(there.tolist())
            out = [t if f == "plain" else _arranged(f, t[:i], t[i:j], t[j:]) for t, f, i, j in zip(texts, form.tolist(), *at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scan.total[:, 0]), pa.array(form, pa.string()), *_counts(form, a, b - a), pa.array(out, pa.binary())], names=["id", "n", "form", "prefix_units", "middle_units", "output"])

    return rows.select("id", "text", *choice.hashes()).mapInArrow(run, f"{COLUMNS}, output binary")


def restore_ordinary(done: DataFrame) -> DataFrame:
    """The rows of transform_ordinary with a column restored: the text, rebuilt from output and form alone."""
    names = done.columns
    at = [names.index(c) for c in ("output", "form")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton()
        for batch in batches:
            out, form = batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()
            docs = np.array([k for k, f in enumerate(form) if f != "plain"], np.int64)
            scan = Scan(auto, [out[k] for k in docs.tolist()])
            ends = [scan.find(np.arange(len(docs)), 1, np.full(len(docs), k)).tolist() for k in range(3)]
            for k, x, y, z in zip(docs.tolist(), *ends, strict=True):
                t = out[k]
                one, two, middle = t[x + 1 : y - 2], t[y + 1 : z - 2], t[z + 1 :]
                out[k] = one + middle + two if form[k] == "psm" else two + middle + one
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*names, "restored"])

    return done.mapInArrow(run, T.StructType([*done.schema.fields, T.StructField("restored", T.BinaryType())]))


def deal_giants(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, id, at, data): pieces of rows (id, text in bytes) with their place in the text, dealt over all tasks and written to the shared folder."""
    n = F.ceil(F.octet_length("text") / piece).cast("int")
    cutting = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((k.cast("long") * piece).alias("at"), F.substring(F.col("text"), k * piece + 1, F.lit(piece)).alias("data")))
    named = rows.select(F.monotonically_increasing_id().alias("key"), "id", "text")  # before the pieces are made, so one a document
    some = named.select("key", "id", F.explode(cutting).alias("p")).select("key", "id", "p.*")
    return common.cut(some.repartition(common.default_parts(rows.sparkSession), "key", "at"), "pieces")


def folded(pieces: DataFrame, unit: str = "char") -> DataFrame:
    """(key, size, units, marks, steps) of documents in pieces (key, at, data): totals, and for each piece (at, entry, units, marks): the state it is entered in and the counts before it.

    Only the pieces' functions are brought together: a few numbers a piece, and a document can't be over 2 GB."""
    kind = "at long, size long, state array<long>, units array<long>, marks array<long>"
    step = pa.list_(pa.struct([(c, pa.int64()) for c in ("at", "entry", "units", "marks")]))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(unit)
        for batch in batches:
            data = batch.column(2).to_pylist()
            state, count = Scan(auto, data).function
            cols = [pa.array([len(x) for x in data], pa.int64()), *(pa.array(x.tolist(), pa.list_(pa.int64())) for x in (state, count[..., 0], count[..., 1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["key", "at", "size", "state", "units", "marks"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state, count = np.array([x["state"] for x in f]), np.stack([np.array([x[c] for x in f]) for c in ("units", "marks")], -1)
                first = np.zeros(len(f), np.int64)
                entry, before, upto = entered(*compose(state, count, first), first, first)
                steps = [{"at": x["at"], "entry": e, "units": u, "marks": m} for x, e, (u, m) in zip(f, entry.tolist(), before.tolist(), strict=True)]
                cols = [[key], [f[-1]["at"] + f[-1]["size"]], [int(upto[-1, 0])], [int(upto[-1, 1])]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([steps], step)], names=["key", "size", "units", "marks", "steps"])

    told = pieces.select("key", "at", "data").mapInArrow(tell, f"key long, {kind}")
    lists = told.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "size", "state", "units", "marks"))).alias("f"))
    return lists.mapInArrow(fold, "key long, size long, units long, marks long, steps array<struct<at: long, entry: long, units: long, marks: long>>")


def located(pieces: DataFrame, wants: DataFrame, field: str, unit: str = "char") -> DataFrame:
    """(key, which, place): the byte at which event number k of a field happens, for wants (key, which, k, step), step being the piece it happens in. Only those pieces are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(unit)
        for batch in batches:
            at, entry, k = (batch.column(c).to_numpy() for c in (2, 3, 4))
            scan = Scan(auto, batch.column(5).to_pylist(), entry)
            place = at + scan.find(np.arange(batch.num_rows), int(field == "marks"), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.int64())], names=["key", "which", "place"])

    there = wants.select("key", "which", F.col("step.at").alias("at"), F.col("step.entry").alias("entry"), (F.col("k") - F.col(f"step.{field}")).alias("k"))
    found = pieces.select("key", "at", "data").join(there, ["key", "at"]).select("key", "which", "at", "entry", "k", "data")
    return found.mapInArrow(run, "key long, which int, place long")


def _want(k: Column | int, which: int, field: str) -> Column:
    k = F.lit(k).cast("long") if isinstance(k, int) else k
    return F.struct(F.lit(which).alias("which"), k.alias("k"), F.element_at(F.filter("steps", lambda s: s[field] <= k), -1).alias("step"))


def moved(pieces: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, at, data) of new documents, by plan (key, segments of (lo, hi, to), heads of (at, data)): bytes lo to hi of the old one go to place `to`."""
    lo, hi = F.greatest("s.lo", "at"), F.least(F.col("s.hi"), F.col("at") + F.octet_length("data"))
    cut = pieces.select("key", "at", "data").join(plan.select("key", "segments"), "key").select("key", "at", "data", F.explode("segments").alias("s")).where(lo < hi)
    cut = cut.select("key", (F.col("s.to") + lo - F.col("s.lo")).alias("to"), F.substring(F.col("data"), (lo - F.col("at")).cast("int") + 1, (hi - lo).cast("int")).alias("data"))
    return cut.toDF("key", "at", "data").union(plan.select("key", F.explode("heads").alias("h")).select("key", "h.at", "h.data"))


def _plan(order: list[tuple[bytes | None, Column, Column]]) -> tuple[Column, Column]:
    """(segments, heads) of a document laid out as (marker, lo, hi) one after the other."""
    segments, heads, to = [], [], F.lit(0).cast("long")
    for head, lo, hi in order:
        if head:
            heads.append(F.struct(to.alias("at"), F.lit(head).alias("data")))
            to = to + len(head)
        segments.append(F.struct(lo.alias("lo"), hi.alias("hi"), to.alias("to")))
        to = to + hi - lo
    return F.array(*segments), F.array(*heads) if heads else F.array().cast("array<struct<at: long, data: binary>>")


def _told(base: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """base with the places found for its keys as columns p0, p1, ..."""
    return base.join(found.groupBy("key").agg(*[F.max(F.when(F.col("which") == k, F.col("place"))).alias(f"p{k}") for k in range(n)]), "key", "left")


def transform_giants(pieces: DataFrame, choice: Choice) -> tuple[DataFrame, DataFrame]:
    """((key, id, n, form, prefix_units, middle_units), (key, at, data) of the outputs) of documents in pieces; both are written."""
    n, h = F.col("units"), [F.col(f"h{k}") for k in range(1, 5)]
    base = folded(pieces, choice.unit).join(pieces.where("at = 0").select("key", "id", *choice.hashes()), "key")
    form = F.when((F.col("marks") > 0) | (h[2] % 100 >= 100 - choice.plain_pct), "plain").when(h[3] % 100 < choice.spm_pct, "spm").otherwise("psm")
    base = base.select("key", "id", "size", n.alias("n"), form.alias("form"), F.least(h[0] % (n + 1), h[1] % (n + 1)).alias("a"), F.greatest(h[0] % (n + 1), h[1] % (n + 1)).alias("b"), "steps")
    base = common.cut(base, "giants")
    wants = base.where("form <> 'plain'").select("key", F.explode(F.array(*[_want(F.col(c), w, "units") for w, c in enumerate("ab")])).alias("w"), "n").select("key", "w.*", "n").where("k > 0 AND k < n")
    place = lambda k, p: F.when(F.col(k) == 0, 0).when(F.col(k) == F.col("n"), F.col("size")).otherwise(F.col(p)).cast("long")
    rows = _told(base.drop("steps"), located(pieces, wants, "units", choice.unit), 2).withColumns({"x": place("a", "p0"), "y": place("b", "p1")})
    zero, x, y, size = F.lit(0).cast("long"), F.col("x"), F.col("y"), F.col("size")
    plans = {
        "plain": _plan([(None, zero, size)]),
        "psm": _plan([(PREFIX, zero, x), (SUFFIX, y, size), (MIDDLE, x, y)]),
        "spm": _plan([(SUFFIX, y, size), (PREFIX, zero, x), (MIDDLE, x, y)]),
    }
    return _choice_rows(rows), common.cut(moved(pieces, _by_form(rows, plans)), "outputs")


def _by_form(rows: DataFrame, plans: dict[str, tuple[Column, Column]]) -> DataFrame:
    pick = lambda k: F.coalesce(*[F.when(F.col("form") == f, p[k]) for f, p in plans.items()])
    return rows.select("key", pick(0).alias("segments"), pick(1).alias("heads"))


def _choice_rows(rows: DataFrame) -> DataFrame:
    cut = F.col("form") != "plain"
    return rows.select("key", "id", "n", "form", F.when(cut, F.col("a")).alias("prefix_units"), F.when(cut, F.col("b") - F.col("a")).alias("middle_units"))


def restore_giants(outputs: DataFrame, forms: DataFrame) -> DataFrame:
    """(key, at, data) of the texts, rebuilt from outputs in parts and forms (key, form) alone: the markers are found by the same scan."""
    base = folded(outputs).join(forms.select("key", "form"), "key")
    wants = base.where("form <> 'plain'").select("key", F.explode(F.array(*[_want(k, k, "marks") for k in range(3)])).alias("w")).select("key", "w.*")
    rows = _told(base.drop("steps"), located(outputs, wants, "marks"), 3)
    one, two, middle = (F.col("p0") + 1, F.col("p1") - 2), (F.col("p1") + 1, F.col("p2") - 2), (F.col("p2") + 1, F.col("size"))
    plans = {"plain": [(F.lit(0).cast("long"), F.col("size"))], "psm": [one, middle, two], "spm": [two, middle, one]}
    return moved(outputs, _by_form(rows, {f: _plan([(None, *x) for x in p]) for f, p in plans.items()}))


def stream_sha256(parts: DataFrame, name: str) -> DataFrame:
    """(key, name): lowercase hex of the SHA-256 of each document's parts in order, hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([running.hexdigest()])], names=["key", name])
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    if running:
                        yield done()
                    key, running = k, hashlib.sha256()
                running.update(data.as_buffer())
        if running:
            yield done()

    dealt = parts.repartition(common.default_parts(parts.sparkSession), "key").sortWithinPartitions("key", "at")
    return dealt.select("key", "data").mapInArrow(run, f"key long, {name} string")


def fill_in_middle(docs: DataFrame, choice: Choice | None = None, giant: int = GIANT, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(transform_ordinary of texts up to `giant` bytes, transform_giants of the others, None if there are none)."""
    choice = choice or Choice()
    rows = common.keyed(docs, id_col, text_col)
    pieces = deal_giants(rows.where(F.octet_length("text") > giant), piece)
    return transform_ordinary(rows.where(F.octet_length("text") <= giant), choice), None if pieces.isEmpty() else transform_giants(pieces, choice)


def digests(ordinary: DataFrame, giants: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """One row a document: (id, n, form, prefix_units, middle_units, output_sha256, restored_sha256)."""
    names = ["id", "n", "form", "prefix_units", "middle_units"]
    out = restore_ordinary(ordinary).select(*names, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
    if giants:
        rows, parts = giants
        more = rows.join(stream_sha256(parts, "output_sha256"), "key").join(stream_sha256(restore_giants(parts, rows), "restored_sha256"), "key")
        out = out.union(more.select(*names, "output_sha256", "restored_sha256"))
    return out


def op11_fill_middle(spark, sf_dir):
    done = digests(*fill_in_middle(common.table(spark, sf_dir, "documents")))
    return done.select(common.real_id(), "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), "output_sha256", "restored_sha256")
