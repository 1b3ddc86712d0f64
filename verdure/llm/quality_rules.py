"""Operator 7: quality rules as a short-circuit cascade.

Each rule reads figures of a text that are worked out when first asked for. On a random sample of about SAMPLE
documents the cost and the rejections of each rule are measured, and rules are tried in the order of rejections per
cost, of what earlier rules let through; the first that rejects ends a document. The order changes no verdict. Nothing is shuffled.

Defined results: a text without words (null and empty too) has zero figures and is rejected by too_few_words;
rows with null ids and repeated rows are judged like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import common

SAMPLE = 400
WINDOW = 8
_CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Figures:
    """Figures of one text (UTF-8), each worked out once if asked for."""

    def __init__(self, text: bytes):
        self.text = text

    def count(self, chars: bytes) -> int:
        return len(self.text) - len(self.text.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, _CONTINUED + _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return self.count(_SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self.count(_UPPER)

    @cached_property
    def _lines(self) -> tuple[int, int]:
        lines = [x for x in self.text.split(b"\n") if x and not x.isspace()]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_lines(self) -> int:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> int:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        seen: dict[bytes, int] = {}
        name = np.array([seen.setdefault(w, len(seen)) for w in self.words], np.int64)
        half = 1
        while half < WINDOW:  # names of windows twice as long, by pairs of names
            pair = name[:-half] * (int(name.max()) + 1) + name[half:]
            _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
            half *= 2
        covered = np.zeros(self.n_words + 1, np.int64)
        at = np.flatnonzero(times[name] > 1)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
        return int((np.cumsum(covered)[:-1] > 0).sum())


#: name -> whether it rejects.
RULES: dict[str, Callable[[Figures], bool]] = {
    "too_few_words": lambda f: f.n_words < 20,
    "repeated_words": lambda f: 100 * f.n_repeat_words > 30 * f.n_words,
    "symbols": lambda f: 100 * f.n_symbols > 10 * f.n_words,
    "repeated_lines": lambda f: 100 * f.n_dup_lines > 40 * f.n_lines,
    "word_length": lambda f: not 3 * f.n_words <= f.word_chars <= 10 * f.n_words,
    "upper_case": lambda f: 100 * f.n_upper > 30 * f.word_chars,
}
BASE = ("too_few_words", "repeated_words")


def rule_order(docs: DataFrame, rules: dict[str, Callable[[Figures], bool]] | None = None, sample: int = SAMPLE, text_col: str = "text") -> list[str]:
    """Names, each the one that rejects most per second of what those before it let through, judged on a random sample of about
    `sample` documents of the whole table; by name where equal. Tasks measure; how often each set of rules rejects, and each rule's
    seconds (to a power of two, so that the order doesn't hang on a little noise), reach the driver."""
    rules = RULES if rules is None else rules
    names = sorted(rules)
    n = docs.count()
    some = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).sample(fraction=min(1.0, sample / max(n, 1)), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, sets = [0.0] * len(names), {}
        for batch in batches:
            for t in batch.column(0):
                text, bits = t.as_py().encode(), 0
                for k, name in enumerate(names):
                    began = time.perf_counter()
                    bits |= rules[name](Figures(text)) << k
                    took[k] += time.perf_counter() - began
                sets[bits] = sets.get(bits, 0) + 1
        rows = [(True, k, v) for k, v in sets.items()] + [(False, k, v) for k, v in enumerate(took)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.bool_(), pa.int64(), pa.float64()), strict=True)], names=["set", "k", "n"])

    got = some.mapInArrow(run, "set boolean, k long, n double").groupBy("set", "k").agg(F.sum("n").alias("n")).collect()
    left = {r.k: r.n for r in got if r.set}
    took = {names[r.k]: 2.0 ** round(math.log2(max(r.n, 1e-9))) for r in got if not r.set}
    out: list[str] = []
    while len(out) < len(names):
        worth = {x: sum(n for bits, n in left.items() if bits >> k & 1) / took.get(x, 1.0) for k, x in enumerate(names) if x not in out}
        out.append(min(worth, key=lambda x: (-worth[x], x)))
        left = {bits: n for bits, n in left.items() if not bits >> names.index(out[-1]) & 1}
    return out


def judge(docs: DataFrame, order: list[str] | None = None, figures: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, [figures, base_failed,] rejected_by): rejected_by is the first rule in order that rejects, null if none does."""
    order = rule_order(docs, text_col=text_col) if order is None else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in common.slices(batches):
            fs = [Figures(t) for t in texts]
            cols = [pa.array(ids)]
            if figures:
                cols += [pa.array([getattr(f, k) for f in fs], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                cols.append(pa.array([any(RULES[k](f) for k in BASE) for f in fs]))
            cols.append(pa.array([next((k for k in order if RULES[k](f)), None) for f in fs], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, " + "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, " * figures + "rejected_by string"
    names = [x.split()[0] for x in schema.split(", ")]
    return common.keyed(docs, id_col, text_col).mapInArrow(run, schema)


def passing(docs: DataFrame, order: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that no rule rejects; each rule runs only on what the rules before it let through."""
    order = rule_order(docs, text_col=text_col) if order is None else order
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t.as_py() or "").encode() for t in batch.column(at))
            yield batch.filter(pa.array([not any(RULES[k](f) for k in order) for f in map(Figures, texts)], pa.bool_()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any names may stand above
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_quality_rules(spark, sf_dir):
    found = judge(common.table(spark, sf_dir, "documents"), figures=True)
    return found.select(common.real_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", found.rejected_by.isNull().alias("kept"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, CASE WHEN count(*) OVER f = 8 THEN array_to_string(list(word) OVER f, ' ') END AS gram FROM w
  WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
c AS (SELECT r, i, (gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1)::INT AS twice FROM g),
v AS (SELECT r, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM c),
n AS (SELECT r, count(*) AS n_words, sum(hit)::BIGINT AS n_repeat_words FROM v GROUP BY r),
f AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN n USING (r)),
s AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 40 * len(lines)
    OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_upper > 30 * word_chars) AS kept
FROM s
"""
