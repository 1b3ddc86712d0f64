"""Operator 6: a sparse rule ensemble for quality.

Shallow boosted trees are grown on figures of labelled texts; every path from a root is a conjunctive rule;
a lasso-penalised logistic regression keeps few of the rules; these are compiled into one Spark column
expression over the figures. The figures of all texts are worked out once, in Arrow batches, and kept.

The fit uses at most SAMPLE labelled rows, the first by hash of their id; scoring covers every row.

Defined results: a null or empty text has zero figures and is scored as such; null labels and labels without
a document are not learnt from; without any usable label, or with one class only, the score is the smoothed
share of label 1; rows with a null id count as held out of learning; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm import common
from verdure.llm.quality_rules import Figures

SAMPLE = 20_000
FOLDS, THRESHOLD = 5, 0.3
TREES, DEPTH, RATE, LEAF = 30, 3, 0.3, 20
_DIGITS = b"0123456789"


def figures(text: bytes) -> tuple[float, ...]:
    f = Figures(text)
    n, chars = max(f.n_words, 1), max(f.word_chars, 1)
    return (
        f.n_words, f.word_chars / n, f.n_symbols / n, f.n_upper / chars, f.count(_DIGITS) / chars, f.count(b"!?") / n, f.count(b".,;:") / n,
        f.n_lines / n, f.n_dup_lines / max(f.n_lines, 1), f.n_repeat_words / n, len(set(f.words)) / n, f.count(b"@/_~^=+[]{}()\\\"'") / n,
    )


FIGURES = ["words", "word_length", "symbols", "upper", "digits", "marks", "stops", "lines", "dup_lines", "repeats", "distinct", "signs"]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, FIGURES...) of every text, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in common.slices(batches):
            rows = np.array([figures(t) for t in texts], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(rows[:, k]) for k in range(len(FIGURES)))], names=["id", *FIGURES])

    return common.cut(common.keyed(docs, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"{k} double" for k in FIGURES)), "figures")


#: A rule: (figure, below, cut) conditions, all of which must hold; below: figure < cut, else figure >= cut.
Rule = tuple[tuple[int, bool, float], ...]


def _fires(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, below, at in rule:
        out &= (x[:, k] < at) == below
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = 32) -> list[Rule]:
    """Paths of boosted trees (logistic loss, second-order gains over quantile cuts)."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    z, rules = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)

        def split(rows: np.ndarray, path: Rule):
            if path:
                rules.append(path)
            best = (1e-6, None, 0)
            if len(path) < depth and len(rows) >= 2 * LEAF:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for k, code in enumerate(codes):
                    c = code[rows]
                    n, gs, hs = (np.cumsum(np.bincount(c, w, minlength=len(cuts[k]) + 1))[:-1] for w in (None, g[rows], h[rows]))
                    if not len(n):
                        continue
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                    gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (gain.max(), k, int(gain.argmax()))
            if best[1] is None:
                z[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
                return
            _, k, b = best
            low = codes[k][rows] <= b
            for below, part in ((True, rows[low]), (False, rows[~low])):
                split(part, (*path, (k, below, float(cuts[k][b]))))

        split(np.arange(len(y)), ())
    return list(dict.fromkeys(rules))


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) of logistic regression with an L1 penalty, by accelerated proximal steps; the intercept is free."""
    a = np.column_stack([np.ones(len(y)), r]).astype(np.float64)
    w = np.zeros(a.shape[1])
    w[0] = math.log(y.mean() / (1 - y.mean()))
    v = np.random.default_rng(0).normal(size=a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / np.linalg.norm(a @ v) ** 2 * 0.95
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -40, 40)))
        new = ahead - step * (a.T @ (p - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (last - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights)."""
    ones = float(y.sum())
    if not 0 < ones < len(y):
        share = (ones + 1) / (len(y) + 2)
        return math.log(share / (1 - share)), []
    rules = grow(x, y)
    fires = np.array([_fires(x, r) for r in rules]).T if rules else np.empty((len(y), 0))
    base, w = lasso(fires, y, penalty)
    return base, [(r, float(v)) for r, v in zip(rules, w, strict=True) if v]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The model's score as a column over FIGURES."""
    z = F.lit(model[0])
    for rule, weight in model[1]:
        holds = F.lit(True)
        for k, below, at in rule:
            holds &= F.col(FIGURES[k]) < at if below else F.col(FIGURES[k]) >= at
        z += F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score)."""
    found = measure(docs, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % folds == 0, F.lit(True)) | (F.col("id") == common.NULL_ID)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    share = 2 * sample / max(1, marks.count())
    rows = found.where(~held & common.hash_share(F.col("id"), share)).join(marks.where(common.hash_share(F.col("id"), share)), "id").orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1), "id", "label").limit(sample).select("label", *FIGURES).toPandas().to_numpy(np.float64)
    model = fit(rows[:, 1:], rows[:, 0])
    return found.select("id", held.alias("held_out"), compiled(model).alias("score"))


def op6_quality_classifier(spark, sf_dir):
    found = score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select(common.real_id(), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
