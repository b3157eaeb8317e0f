"""Quality: a sparse ensemble of rules over text statistics, compiled to Spark column expressions.

Shallow trees are boosted on a bounded sample of labelled rows. Every path from a root becomes a
conjunctive rule over statistics; a lasso logistic regression gives most rules no weight. The rest is
compiled into one column expression over the statistics, which are taken from whole texts.

Defined cases: null and empty texts have all statistics 0 and a score like any other; shares of nothing
are 0; ids, sources, languages and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches
from .labelled import training_sample
from .words import Words, slices

STATISTICS = ("words", "word_length", "symbols", "repeated_lines", "capitals", "digits", "stops", "distinct", "repeated_grams", "lines", "bars", "longest_share")
#: Trees, their depth, candidate cuts of a statistic, rows that a leaf needs.
TREES, DEPTH, CUTS, LEAF = 40, 3, 32, 20
L1 = 5e-4


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _CAPITALS, _DIGITS, _STOPS, _BARS = _class(b"#*$%&<>"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:!?"), _class(b"|")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row for each text, a column for each of STATISTICS."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for a, b, data, offsets in slices(texts):
        w = Words(data, offsets, lower=False)

        def per_text(table: np.ndarray, data=data, offsets=offsets) -> np.ndarray:
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=total[1:])
            return np.diff(total[offsets])

        size = np.maximum(1, np.diff(offsets))
        n = np.diff(w.first)
        some = np.maximum(1, n)
        lengths = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        o = out[a:b]
        o[:, 0], o[:, 1] = n, np.diff(lengths[w.first]) / some
        for column, table in ((2, _SYMBOLS), (4, _CAPITALS), (5, _DIGITS), (6, _STOPS), (10, _BARS)):
            o[:, column] = per_text(table) / size
        grams = w.grams(3)
        raw = data.tobytes()
        for i, (f, g, x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if g == f:
                continue
            kinds, count = np.unique(w.hashes[f:g], return_counts=True)
            o[i, 7], o[i, 11] = len(kinds) / (g - f), count.max() / (g - f)
            if g - f > 3:
                o[i, 8] = 1 - len(np.unique(grams[f : g - 2])) / (g - f - 2)
            lines = [x for x in raw[x:y].split(b"\n") if x.strip()]
            o[i, 9] = len(lines)
            o[i, 3] = 1 - len(set(lines)) / max(1, len(lines))
    return out


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(len(STATISTICS))]], names=["kept", *STATISTICS])


def _with(rows: DataFrame) -> DataFrame:
    """(kept, text) to kept and the statistics."""
    return rows.mapInArrow(_with_statistics, f"kept {rows.schema['kept'].dataType.simpleString()}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A rule: conditions (statistic, at_most or above, cut), all of which must hold.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, rules: list[Rule], leaf: np.ndarray) -> None:
    total_g, total_h = gradient[rows].sum(), curvature[rows].sum()
    best, at = 1e-6, None
    if depth and len(rows) >= 2 * LEAF:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            place = np.searchsorted(c, x[rows, j], "left")  # x <= c[place]
            g = np.cumsum(np.bincount(place, gradient[rows], len(c) + 1))[:-1]
            h = np.cumsum(np.bincount(place, curvature[rows], len(c) + 1))[:-1]
            n = np.cumsum(np.bincount(place, minlength=len(c) + 1))[:-1]
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            if gain.max() > best:
                best, at = gain.max(), (j, float(c[gain.argmax()]))
    if at is None:
        leaf[rows] = -total_g / (total_h + 1)
        return
    j, cut = at
    for low in (True, False):
        part = rows[(x[rows, j] <= cut) == low]
        rules.append((*path, (j, low, cut)))
        _grow(x, gradient, curvature, cuts, part, rules[-1], depth - 1, rules, leaf)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) == low
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, l1: float = L1, steps: int = 500) -> tuple[list[tuple[Rule, float]], float]:
    """(rules with their weights, intercept)."""
    if len(np.unique(y)) < 2:
        rate = (float(np.sum(y)) + 0.5) / (len(y) + 1)
        return [], float(np.log(rate / (1 - rate)))
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1]))
        distinct = np.unique(x[:, j])
        # between a value and the next above it, so that compiled comparisons do not hang on the last digit
        nxt = np.searchsorted(distinct, values, "right")
        ok = nxt < len(distinct)
        cuts.append((values[ok] + distinct[nxt[ok]]) / 2)
    margin = np.full(len(y), float(np.log(y.mean() / (1 - y.mean()))))
    every: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        leaf = np.zeros(len(y))
        _grow(x, p - y, p * (1 - p), cuts, np.arange(len(y)), (), DEPTH, every, leaf)
        margin += 0.3 * leaf
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in every))
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    _, first = np.unique(a, axis=1, return_index=True)
    first = np.sort(first)
    rules, a = [rules[i] for i in first], a[:, first]
    n = len(y)
    gram = np.linalg.norm(a, 2) ** 2 / (4 * n) + 0.25
    w, b, z, zb, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ z + zb)))
        new = z - (a.T @ (p - y) / n) / (2 * gram)
        new = np.sign(new) * np.maximum(0, np.abs(new) - l1 / (2 * gram))
        new_b = zb - float((p - y).mean()) / (2 * gram)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        z, zb, w, b, t = new + m * (new - w), new_b + m * (new_b - b), new, new_b, t2
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b


def compile_score(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The ensemble as an expression over the statistics' columns."""
    total = F.lit(intercept)
    for rule, weight in rules:
        condition = F.lit(True)
        for j, low, cut in rule:
            c = F.col(STATISTICS[j])
            condition = condition & (c <= F.lit(cut) if low else c > F.lit(cut))
        total = total + F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[list[tuple[Rule, float]], float]:
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, label).select(F.struct("y").alias("kept"), "text")
    table = _with(sample).select("kept.y", *STATISTICS).toArrow()  # at most SAMPLE_ROWS rows
    x = np.stack([np.asarray(table[s], float) for s in STATISTICS], axis=1)
    order = np.lexsort(x.T)
    return fit_rules(x[order], np.asarray(table["y"], float)[order])


def score(docs: DataFrame, model: tuple[list[tuple[Rule, float]], float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: kept (a struct of the columns in keep), the statistics and score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    return _with(rows).withColumn("score", compile_score(*model))
