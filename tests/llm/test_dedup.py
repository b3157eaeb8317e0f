import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.llm import minhash, substring_dedup
from tideway.llm.components import connected_components
from tideway.llm.fm_index import FMIndex

SCHEMA = "doc_id long, text string, id string, h string, kept string"


def corpus(seed=1, n=60):
    """Copies, near copies, passages, blanks, nulls, one word repeated, other white space, and columns with clashing names."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["a", "ö", "xy", ""])
    base = [[word() for _ in range(rng.randint(0, 90))] for _ in range(n)]
    passage = [word() + "P" for _ in range(50)]
    for i in range(0, n, 5):
        at = rng.randint(0, len(base[i]))
        base[i] = base[i][:at] + passage + base[i][at:]
    for i in range(1, n, 7):
        base[i] = list(base[i - 1])
        if base[i]:
            base[i][rng.randrange(len(base[i]))] = "EDIT"
    rows = [(i, rng.choice([" ", "\t", "\n", "\x0b", "  "]).join(w)) for i, w in enumerate(base)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "same " * 400), (n + 4, rows[3][1]), (n + 5, rows[3][1]), (n + 6, "One two"), (n + 7, "oNE two"), (n + 8, "é" * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_substring_dedup(spark, hot):
    rows = corpus()
    got = substring_dedup.remove_repeats(frame(spark, rows), 35, hot=hot).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring_dedup(rows, 35))
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in got)


@pytest.mark.parametrize("length", [1, 2, 13])
def test_substring_dedup_other_windows(spark, length):
    rows = corpus(2, 25)
    got = substring_dedup.remove_repeats(frame(spark, rows), length, with_text=False).collect()
    assert sorted((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute.substring_dedup(rows, length))


def test_substring_dedup_repeated_rows_and_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "other " + text[:30]), (None, text), (None, None)]
    got = substring_dedup.remove_repeats(frame(spark, rows), 35).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute.substring_dedup(rows, 35), key=key)
    assert substring_dedup.remove_repeats(frame(spark, rows).limit(0), 35).collect() == []


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    for _ in range(40):
        segments = [rng.integers(0, 4, rng.integers(3, 25)).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        lengths = np.array(list(map(len, segments)))
        runs = FMIndex(np.concatenate(segments), lengths).repeated_windows(lengths - 2, 3, piece=int(rng.integers(1, 4)))
        seen = [tuple(s[i : i + 3]) for s in segments for i in range(len(s) - 2)]
        for s, r in zip(segments, runs, strict=True):
            got = sorted(x for a, b in zip(r[::2], r[1::2], strict=True) for x in range(a, b + 1))
            assert got == [i for i in range(len(s) - 2) if seen.count(tuple(s[i : i + 3])) > 1]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = corpus(3)
    got = minhash.near_duplicates(frame(spark, rows), percent).collect()
    assert sorted((r.id, r.n_shingles, r.component_id, r.id == r.component_id) for r in got) == sorted(brute.near_dedup(rows, percent))


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Variants of one text on either side of the threshold, so that large keys hold several components."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(w[: rng.randint(95, 120)])))
    for rare, rounds in ((40, 3), (3, 0)):
        monkeypatch.setattr(minhash, "RARE", rare)
        monkeypatch.setattr(minhash, "ROUNDS", rounds)
        got = minhash.near_duplicates(frame(spark, rows), 85).collect()
        assert sorted((r.id, r.n_shingles, r.component_id, r.id == r.component_id) for r in got) == sorted(brute.near_dedup(rows, 85))


def test_keep_one(spark):
    rows = [*corpus(5, 30), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g")]
    kept = minhash.keep_one(frame(spark, rows), 80)
    got = sorted((r.doc_id is None, r.doc_id, r.text or "") for r in kept.collect())
    want = {d for d, _, _, k in brute.near_dedup([r for r in rows[:-3]] + [(7_000, "a b c d e f g")], 80) if k}
    assert {d for _, d, _ in got if d is not None} - {7} == want - {7, 7_000}
    assert sum(t == "a b c d e f g" for _, _, t in got) == 1
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_keep_one_leaves_blank_rows(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (8, ""), (8, ""), (None, None), (None, None)]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, ""), (7, "a b c d e f g"), (8, ""), (8, "")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(50)] + [(i, i + 1) for i in range(100, 160)]
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: c for v, c in parent.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, n, n, dtype=np.uint64)) for n in (1, 3, 40, 300, 5000) for _ in range(4)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    words = minhash.parity_sketches(np.concatenate(sets), bounds).reshape(len(sets), -1)
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    for a in range(len(sets)):
        for b in range(len(sets)):
            apart = len(np.setxor1d(sets[a], sets[b]))
            differ = int((bits[a] != bits[b]).sum())
            assert differ <= apart and (apart > 40 or differ >= apart / 2)
    assert minhash.parity_sketches(sets[0][:0], np.array([0, 0, 0])).tolist() == [0] * (2 * minhash.BITS // 64)


def test_banding_misses_little():
    for t in (0.8, 0.85, 0.95):
        m, q = minhash.sub_keys(t), t**minhash.R
        assert 1 - (1 - (1 - q) ** m) ** 2 <= minhash.MISS and (m == 1 or 1 - (1 - (1 - q) ** (m - 1)) ** 2 > minhash.MISS)
    assert F is not None
