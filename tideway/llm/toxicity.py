"""Toxicity: a sparse logistic model over words, regularised by counterfactuals.

Identity terms in labelled sentences are swapped for others of their group (`swaps`), and the square of
the change of the score is penalised along with the size of the weights, so that the mere mention of a
group does not move the score. The model is fitted on the driver, on a bounded sample of labelled rows;
its features are words and their beginnings of PREFIXES bytes, by 64-bit hash: those in at least MIN_DOCS
of the sample's texts, of which the SCREEN that differ most between the labels are taken, and all that
a swap takes out or puts in. Tasks count the sample's features, and only those that the fit can use come to
the driver. Only features with a weight go to the tasks that score whole texts.

Defined cases: null and empty texts get the score of the intercept; words count once a text; ids,
sources, languages and labels are no inputs of a score; without labels the score is one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import scratch, small_batches, stored
from .labelled import fold, training_sample
from .words import Words, slices

#: Separators of words: ASCII but letters and digits.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False

#: Terms that may stand for each other in a sentence without changing how toxic it is.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: Beginnings of longer words that are features like words, so that inflected words share a weight.
PREFIXES = (4, 5, 6)
MIN_DOCS = 3
SCREEN = 1_500
#: Labelled rows of each label that the model is fitted on, at most.
ROWS_A_LABEL = 4_000
#: What `_bags` gives.
BAGS = "bag array<long>, y int, shared array<long>, size long, least long"
#: Strengths of the penalties: size of weights, change of score under a swap.
L1, SWAP = 1e-4, 1.0


def word_hashes(terms: list[str]) -> np.ndarray:
    data = " ".join(terms).encode()
    return Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True, blank=SEPARATOR).hashes


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, word number) of all words and beginnings."""
    size = w.ends - w.starts
    values, places = [w.hashes], [np.arange(len(size))]
    for p in PREFIXES:
        long = np.flatnonzero(size > p)
        values.append(w.prefix_hash(long, p))
        places.append(long)
    return np.concatenate(values), np.concatenate(places)


def term_features(term: str) -> np.ndarray:
    """The features of a text of this one word."""
    data = term.encode()
    return np.unique(_features(Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True, blank=SEPARATOR))[0])


def swap_features(groups=IDENTITY_GROUPS) -> np.ndarray:
    """The features of all terms, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[term_features(t) for g in groups for t in g]]))


def _bags(batches: Iterator[pa.RecordBatch], groups=IDENTITY_GROUPS, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Texts to the distinct hashes of their features (of those in wanted, if given), those features of terms of a swap that several words of the text have, and how many features there are in all and the first of them."""
    of_terms = swap_features(groups)
    for batch in batches:
        bags: list[np.ndarray] = []
        shared: list[np.ndarray] = []
        size: list[int] = []
        least: list[int | None] = []
        for _, _, data, offsets in slices(batch.column(0)):
            w = Words(data, offsets, lower=True, blank=SEPARATOR)
            values, places = _features(w)
            order = np.argsort(places, kind="stable")
            values, places = values[order], places[order]
            edges = np.searchsorted(places, w.first).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                bag = np.unique(values[a:b])
                size.append(len(bag))
                least.append(int(bag[:1].view(np.int64)[0]) if len(bag) else None)
                bags.append((bag if wanted is None else bag[np.isin(bag, wanted)]).view(np.int64))
                at = a + np.flatnonzero(np.isin(values[a:b], of_terms))
                held = np.unique(np.stack([values[at], w.hashes[places[at]]]), axis=1)[0]
                several, n = np.unique(held, return_counts=True)
                shared.append(several[n > 1].view(np.int64))
        lists = pa.list_(pa.int64())
        columns = [pa.array(bags, lists), batch.column(1), pa.array(shared, lists), pa.array(size, pa.int64()), pa.array(least, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bag", "y", "shared", "size", "least"])


class Sparse:
    """Rows of column numbers with values, for products with dense vectors."""

    def __init__(self, lengths: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.columns, self.values, self.height, self.width = columns, values, len(lengths), width

    def dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * v[self.columns], self.height)

    def t_dot(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * v[self.row], self.width)


def swaps(bags: list[np.ndarray], groups=IDENTITY_GROUPS, shared: list[np.ndarray] | None = None) -> list[tuple[list[int], list[int]]]:
    """Counterfactuals of the sample: (features taken out of a text, features put in), once for each text, term and other member.

    A term takes its word and beginnings with it, less those that other words of the text have (shared).
    """
    named = [[(int(word_hashes([t])[0]), term_features(t).tolist()) for t in group] for group in groups]
    terms = np.array(sorted({word for group in named for word, _ in group}), np.uint64)
    out: list[tuple[list[int], list[int]]] = []
    for bag, stay in zip(bags, shared if shared is not None else [np.zeros(0, np.uint64)] * len(bags), strict=True):
        here = set(bag[np.isin(bag, terms)].tolist())
        if not here:
            continue
        had, kept = set(bag.tolist()), set(stay.tolist())
        for group in named:
            for i, (word, own) in enumerate(group):
                if word in here:
                    leave = [f for f in own if f in had and f not in kept]
                    for j, (_, new) in enumerate(group):
                        if j != i:
                            out.append(([f for f in leave if f not in new], [f for f in new if f not in had]))
    return out


def fit_bags(bags: list[np.ndarray], y: np.ndarray, l1: float = L1, swap: float = SWAP, groups=IDENTITY_GROUPS, steps: int = 600, shared: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature hashes, sorted, with a weight; their weights; intercept), by accelerated proximal gradient."""
    if not bags or len(np.unique(y)) < 2:
        rate = (float(np.sum(y)) + 0.5) / (len(y) + 1)
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate)))
    flat = np.concatenate(bags)
    words, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    n = len(y)
    positive = np.bincount(inverse, np.repeat(y, [len(b) for b in bags]), len(words))
    base = y.mean()
    differs = np.abs(positive - count * base) / np.sqrt(count * base * (1 - base))
    differs[count < MIN_DOCS] = 0
    screen = min(SCREEN, len(differs))
    keep = (differs > 0) & (differs >= (np.partition(differs, -screen)[-screen] if screen else 0))
    pairs = swaps(bags, groups, shared)
    keep |= np.isin(words, np.array(sorted({x for p in pairs for side in p for x in side}), np.uint64)) & (count >= MIN_DOCS)
    number = np.cumsum(keep) - 1
    ok = keep[inverse]
    before = np.concatenate([[0], np.cumsum(ok)])
    lengths = np.diff(before[np.concatenate([[0], np.cumsum([len(b) for b in bags])])])
    vocabulary = words[keep]
    x = Sparse(lengths, number[inverse[ok]], np.ones(int(ok.sum())), len(vocabulary))
    d = _differences(pairs, vocabulary)
    w, b, z, zb, t = np.zeros(len(vocabulary)), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(len(vocabulary)), 0.0, 1.0
    zb = b
    # presence counts bound the curvature: power iteration on X'X / 4n + 2 swap D'D / m
    v = np.random.default_rng(3).random(len(vocabulary))
    for _ in range(20):
        v = x.t_dot(x.dot(v)) / (4 * n) + (2 * swap * d.t_dot(d.dot(v)) / max(1, d.height) if d.height else 0)
        size = np.linalg.norm(v) or 1.0
        v /= size
    step = 1 / (1.2 * size + 0.3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x.dot(z) + zb)))
        g = x.t_dot(p - y) / n
        if d.height:
            g = g + 2 * swap * d.t_dot(d.dot(z)) / d.height
        new = z - step * g
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
        new_b = zb - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t2
        if float(np.dot(z - new, new - w)) > 0:  # the momentum points uphill
            m, t2 = 0.0, 1.0
        z, zb, w, b, t = new + m * (new - w), new_b + m * (new_b - b), new, new_b, t2
    used = w != 0
    return vocabulary[used], w[used], b


def _differences(pairs: list[tuple[list[int], list[int]]], vocabulary: np.ndarray) -> Sparse:
    """A row for each swap: -1 at the features taken out, 1 at those put in; features outside the vocabulary have no weight."""
    number = {v: i for i, v in enumerate(vocabulary.tolist())}
    lengths, columns, values = [], [], []
    for out, new in pairs:
        found = [(number[f], s) for side, s in ((out, -1.0), (new, 1.0)) for f in side if f in number]
        lengths.append(len(found))
        columns += [i for i, _ in found]
        values += [s for _, s in found]
    return Sparse(np.array(lengths, np.int64), np.array(columns, np.int64), np.array(values), len(vocabulary))


def _screened(sample: DataFrame, groups) -> np.ndarray:
    """The features of sample (text, y) that `fit_bags` would screen, and perhaps a few more at the limit."""
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}  # two rows
    if len(n) < 2:
        return np.zeros(0, np.uint64)
    base = n[1] / (n[0] + n[1])
    features = sample.mapInArrow(lambda batches: _bags(batches, groups), BAGS).select(F.explode("bag").alias("feature"), "y")
    often = features.groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").alias("positive")).where(F.col("n") >= MIN_DOCS)
    differs = F.abs(F.col("positive") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    scored = stored(often.select("feature", differs.alias("differs")).where("differs > 0"))
    least = scored.orderBy(F.desc("differs")).limit(SCREEN).agg(F.min("differs")).first()[0]
    if least is None:
        return np.zeros(0, np.uint64)
    found = scored.where(F.col("differs") >= least * (1 - 1e-9)).select("feature").toArrow()
    return np.asarray(found["feature"], np.int64).view(np.uint64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", **how) -> tuple[np.ndarray, np.ndarray, float]:
    """The sample has as many rows of either label as there are, up to ROWS_A_LABEL; the intercept is then set right by the labels' true shares."""
    small_batches(docs.sparkSession)
    taught = labels.where(fold() != 0)
    total = {r[label]: r["count"] for r in taught.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}  # two rows
    groups = how.get("groups", IDENTITY_GROUPS)
    parts = [training_sample(docs, labels.where(F.col(label) == v), label, rows=ROWS_A_LABEL) for v in (0, 1)]
    with scratch():
        sample = stored(parts[0].unionAll(parts[1]))
        wanted = np.union1d(_screened(sample, groups), swap_features(groups))
        rows = sample.mapInArrow(lambda batches: _bags(batches, groups, wanted), BAGS).toArrow()
    y = np.asarray(rows["y"], float)
    size, least = rows["size"].to_pylist(), rows["least"].to_pylist()
    bags, shared = ([np.asarray(b.values, np.int64).view(np.uint64) for b in rows[c]] for c in ("bag", "shared"))
    first = [b"" if x is None else x.to_bytes(8, "little", signed=True) for x in least]
    order = sorted(range(len(y)), key=lambda i: (y[i], size[i], first[i], bags[i].tobytes()))
    words, weights, intercept = fit_bags([bags[i] for i in order], y[order], shared=[shared[i] for i in order], **how)
    if 0 < y.sum() < len(y):
        intercept += float(np.log(total[1] / total[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return words, weights, intercept


def _score(model: tuple[np.ndarray, np.ndarray, float]):
    words, weights, intercept = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, intercept)
            for a, b, data, offsets in slices(batch.column(1)):
                w = Words(data, offsets, lower=True, blank=SEPARATOR)
                if not len(words) or not len(w.hashes):
                    continue
                values, places = _features(w)
                at = np.searchsorted(words, values)
                at[at == len(words)] = 0
                hit = np.flatnonzero(words[at] == values)
                doc = np.searchsorted(w.first, places[hit], "right") - 1
                once = np.unique(doc * np.int64(len(words)) + at[hit])
                out[a:b] += np.bincount(once // len(words), weights[once % len(words)], b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-out)))], names=["kept", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: kept (a struct of the columns in keep) and score."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), f"kept {rows.schema['kept'].dataType.simpleString()}, score double")
