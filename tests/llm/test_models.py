"""The queries of the models, and the graph of personal data, against plain loops."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import sha

from tideway.llm import pii, quality_model, toxicity
from tideway.llm.labelled import FOLDS
from tideway.llm.queries import op2_pii, op3_toxicity, op6_quality_model

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small documents with repeated rows, empty and null texts, one long text and columns with clashing names; labels with a row twice, a null and an id without a document."""
    rng = random.Random(8)
    rows = []
    for i in range(240):
        bad = i % 4 == 0
        words = [rng.choice(WORDS) + rng.choice(["", ".", "7", "\n"]) for _ in range(rng.randint(3, 60))]
        if bad:
            words += [rng.choice(["scum", "Moron"])] * 2
        rows.append((i, " ".join(words) if i % 3 else "| # " + " ".join(w + " same" for w in words)))
    rows += [(500, None), (501, ""), (502, "word " * 20_000), (7, rows[7][1]), (None, "scum moron"), (503, "é über $$")]
    folder = tmp_path_factory.mktemp("models")
    spark.createDataFrame([(d, t, 0.5, "x", 1) for d, t in rows], "doc_id long, text string, score double, kept string, words int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(240)] + [(4, 1, 1), (5, None, None), (9_999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def held_out(d):
    import zlib

    return d is None or zlib.crc32(str(d).encode()) % FOLDS == 0


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def test_toxicity_query(spark, tables):
    folder, rows = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    words, weights, intercept = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    known = dict(zip(words.tolist(), weights.tolist(), strict=True))
    want = []
    for d, t in rows:
        data = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").encode()
        have = {int(f) for w in set(re.findall(rb"[0-9a-z\x80-\xff]+", data)) for f in toxicity.term_features(w.decode())}
        score = 1 / (1 + math.exp(-(intercept + sum(known.get(f, 0.0) for f in have))))
        want.append((d, held_out(d), score, int(score >= 0.5)))
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in op3_toxicity(spark, folder).collect()]
    assert len(got) == len(want)
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == w[3]
    assert all(p == int(d % 4 == 0) for d, h, _, p in got if h and d is not None and d < 240)


def statistics(text):
    b = (text or "").encode()
    w = b.split()
    n, size = len(w), max(1, len(b))
    share = lambda chars: sum(c in chars for c in b) / size
    lines = [x for x in b.split(b"\n") if x.strip()] if w else []
    kinds, grams = Counter(w), {tuple(w[i : i + 3]) for i in range(n - 2)}
    return {
        "words": n, "word_length": sum(map(len, w)) / max(1, n), "symbols": share(b"#*$%&<>"), "capitals": share(bytes(range(65, 91))), "digits": share(b"0123456789"), "stops": share(b".,;:!?"), "bars": share(b"|"),
        "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "distinct": len(kinds) / n if n else 0, "longest_share": max(kinds.values()) / n if n else 0, "repeated_grams": 1 - len(grams) / (n - 2) if n > 3 else 0, "lines": len(lines),
    }


def test_quality_query(spark, tables):
    folder, rows = tables
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rules, intercept = quality_model.fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    want = []
    for d, t in rows:
        s = statistics(t)
        total = intercept + sum(v for rule, v in rules if all((s[quality_model.STATISTICS[j]] <= cut) == low for j, low, cut in rule))
        score = 1 / (1 + math.exp(-total))
        want.append((d, held_out(d), score, int(score >= 0.3)))
    got = [(r.doc_id, r.held_out, r.score, r.predicted) for r in op6_quality_model(spark, folder).collect()]
    for g, w in zip(order(got), order(want), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], abs=1e-9) and g[3] == w[3]
    assert np.mean([p == int(d % 3 > 0) for d, h, _, p in got if h and d is not None and d < 240]) > 0.95


def bootstrap(texts, rounds, support, confidence):
    """pattern -> (score, kind)."""
    often = Counter()
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
        often.update(words)
        often.update(" ".join(p) for p in zip(words, words[1:], strict=False))
    count, seeds = Counter(), defaultdict(Counter)
    for t in texts:
        for a, b, context, form, kind in pii.candidates(t or "", pii.base_spans(t or "")):
            token = t[a:b].lower()
            kind = kind or ("secret" if pii.is_secret(t[a:b]) else None)
            if kind:
                seeds[token][kind] += 1
            for p in pii._patterns(context, form):
                count[p, token] += 1
    total = Counter()
    for (p, _), n in count.items():
        total[p] += n
    graph = {k: n for k, n in count.items() if total[k[0]] >= support and total[k[0]] >= 0.1 * often[k[0].split(" _ ")[0]]}
    sure = {i: {max(c, key=lambda k: (c[k], k)): 1.0} for i, c in seeds.items()}

    def strong(belief):
        score, met = defaultdict(float), Counter()
        for (p, i), n in graph.items():
            for kind, b in belief.get(i, {}).items():
                score[p, kind] += n * b / total[p]
                met[p, kind] += 1
        return {k: s for k, s in score.items() if s >= confidence - 1e-12 and met[k] >= 2}

    belief = sure
    for _ in range(rounds):
        lifted = defaultdict(dict)
        now = strong(belief)
        for p, i in graph:
            if i not in sure:
                for (q, kind), s in now.items():
                    if q == p:
                        lifted[i][kind] = max(lifted[i].get(kind, 0.0), s)
        belief = {**lifted, **sure}
    best = {}
    for (p, kind), s in strong(belief).items():
        best[p] = max(best.get(p, (0.0, "")), (s, kind))
    return best


PRIVATE = ["call me at +1 (482) 555-{}", "call me at 555-{}", "badge EMP-{}", 'token = "ab{}cdef0123456789abcdef"', 'token = "short{}"', "mail a{}@x.org", "on 2018-11-{}", "badge 555-{}"]


def private_rows():
    rng = random.Random(6)
    rows = [(i, f"please {rng.choice(PRIVATE).format(rng.randint(1000, 1020))} now, {rng.choice(PRIVATE).format(rng.randint(1000, 1020))} then") for i in range(150)]
    return rows + [(200, None), (201, ""), (3, rows[3][1]), (None, rows[4][1]), (202, "x" * 60_000 + " 1" * 500)]


@pytest.mark.parametrize("rounds", [1, 3])
def test_pattern_scores(spark, rounds):
    rows = private_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.pattern: (r.score, r.kind) for r in pii.learn_patterns(docs, rounds=rounds, support=4, confidence=0.4).collect()}
    want = bootstrap([t for _, t in rows], rounds, 4, 0.4)
    assert got.keys() == want.keys() and len(want) > 5
    for p, (score, kind) in want.items():
        assert got[p][0] == pytest.approx(score, abs=1e-9) and got[p][1] == kind, p


def test_pii_query(spark, tmp_path):
    rows = private_rows()
    spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, spans string, n_ip int").write.parquet(f"{tmp_path}/documents.parquet")
    known = {r.pattern: r.kind for r in pii.learn_patterns(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    want = []
    for d, t in rows:
        base = pii.base_spans(t or "")
        added = []
        for a, b, context, form, kind in pii.candidates(t or "", base):
            if kind is None and (hit := "secret" if pii.is_secret(t[a:b]) else next((known[p] for p in pii._patterns(context, form) if p in known), None)):
                added.append((hit, a, b))
        want.append((d, sha(pii.spans_text(base)), len(base) + len(added), pii.spans_text(base + added)))
    got = [(r.doc_id, r.base_sha256, r.n_spans, r.spans) for r in op2_pii(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any("secret:" in s for *_, s in got) and any(n > s.count("email") for *_, n, s in got)


def test_toxicity_fit_brings_screened_features(spark, monkeypatch):
    """What comes to the driver has no feature that the fit cannot use, and the model is that of the whole texts."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 12))] + [f"once{i}x{j}" for j in range(20)] * (i % 7 > 0)
        rows.append((i, " ".join([*words, *(["scum"] if i % 3 == 0 and words else []), *(["women", "old"] if i % 5 == 0 else [])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SCREEN", 30)
    given = []
    whole = toxicity.fit_bags
    monkeypatch.setattr(toxicity, "fit_bags", lambda bags, y, **how: given.append(bags) or whole(bags, y, **how))
    model = toxicity.fit(docs, labels)
    taught = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % FOLDS]
    y = np.array([float(i % 3 == 0) for i, _ in taught])
    (all_,) = toxicity._bags(iter([pa.record_batch([pa.array([t for _, t in taught]), pa.array(y.astype(int), pa.int32())], names=["text", "y"])]))
    bags, shared = ([np.asarray(b.values, np.int64).view(np.uint64) for b in all_[c]] for c in ("bag", "shared"))
    order = sorted(range(len(y)), key=lambda i: (y[i], len(bags[i]), bags[i][:1].tobytes()))
    words, weights, _ = whole([bags[i] for i in order], y[order], shared=[shared[i] for i in order])
    assert len(words) and np.array_equal(model[0], words) and np.allclose(model[1], weights, rtol=1e-9, atol=1e-12)
    count = Counter(x for b in bags for x in b.tolist())
    terms = set(toxicity.swap_features().tolist())
    (came,) = given
    assert sum(map(len, came)) < sum(map(len, bags)) / 3
    assert all(count[x] >= toxicity.MIN_DOCS or x in terms for b in came for x in b.tolist())
