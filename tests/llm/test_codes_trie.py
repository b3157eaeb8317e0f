import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_tokens_chat import texts
from tokenizers import Tokenizer

from tideway.llm import prefix_trie, queries, token_counts, vector_codes

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- op11 ---


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label), usable ones in order. (code, error) of each, and the codebooks."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for v in x] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def assign():
        out = []
        for p in range(parts):
            out.append([min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), i) for i, e in enumerate(books[p])) for v in cut[p]])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            mine = defaultdict(list)
            for v, (_, i) in zip(cut[p], got[p], strict=True):
                mine[i].append(v)
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if i in mine else e for i, e in enumerate(books[p])]
    got = assign()
    return [("".join(f"{got[p][r][1]:02x}" for p in range(parts)), sum(got[p][r][0] for p in range(parts))) for r in range(len(rows))], books


def test_nearest_keeps_the_lower_index():
    rng = np.random.default_rng(1)
    for n, dims, spread in ((1, 3, 2), (17, 2, 3), (256, 16, 2), (200, 1, 4), (256, 4, 50)):
        entries, x = rng.integers(-spread, spread, (n, dims)), rng.integers(-spread - 1, spread + 1, (500, dims))
        found, distance = vector_codes.nearest(vector_codes.kd_tree(entries), x)
        d = ((x[:, None] - entries[None]) ** 2).sum(-1)
        assert (found == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_codes(spark):
    rng = random.Random(5)
    bad = [None, [1.0] * 7 + [None], [float("nan")] + [0.0] * 7, [float("inf")] + [0.0] * 7, [], [0.5] * 4]
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(120)]
    rows += [(7, rows[3][1], 1), (7, rows[3][1], 1), (None, rows[9][1], None), *((200 + i, rows[5][1], 3) for i in range(60))]
    df = spark.createDataFrame(rows + [(-i, v, 1) for i, v in enumerate(bad)], "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash"))
    # the first usable length is that of the smallest id: drop the vector of four
    df = df.where("embedding is null or size(embedding) <> 4")
    found, books = vector_codes.compress(df, entries=16, rounds=3)
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.float32).tolist()))
    want, plain_books = plain_codes(rows, entries=16, rounds=3)
    assert [e.tolist() for e in books.entries] == plain_books
    by_label = defaultdict(int)
    for (_, _, label), (_, error) in zip(rows, want, strict=True):
        by_label[label] += error
    expected = sorted(str((i, label, code, error, by_label[label])) for (i, _, label), (code, error) in zip(rows, want, strict=True))
    assert sorted(str((r.id, r.label, r.code, r.error, r.label_error)) for r in found.collect()) == expected


def test_codes_without_rows_and_too_large(spark):
    empty = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(empty)[0].collect() == [] and vector_codes.compress(empty.limit(0))[1] is None
    large = spark.createDataFrame([(1, [3e38] * 4, 1)], empty.schema)
    with pytest.raises(ValueError, match="overflow"):
        vector_codes.compress(large)


def test_op11_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)], i % 3) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r for r in queries.op11_vector_codes(spark, str(tmp_path)).collect()}
    want, books = plain_codes(rows)
    assert [(got[i].code, got[i].error) for i in range(400)] == want
    assert got[0].codebooks_sha256 == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


# --- op12 ---


def plain_trie(paths):
    """paths: conv_id -> turns. conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node."""
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        yield k
        for x in children[k]:
            yield from below(x)

    out = []
    for k, m in members.items():
        under = list(below(k))
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(not children[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def test_merge_gives_sorted_rows_with_their_prefixes(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", 3)
    for n_runs in (1, 2, 5, 9):
        rows = [([bytes([rng.randint(0, 1)]) * 16 for _ in range(rng.randint(0, 12))], c) for c in range(150)]
        rows += [([b"x" * 16] * 30, 1000 + c) for c in range(40)] + [([], 7)]
        blocks = []
        for run in range(n_runs):
            mine = rows[run::n_runs]
            blocks += prefix_trie._blocks(run, [(p, c, [len(p)] * len(p)) for p, c in mine])
        blocks.sort(key=lambda b: (b["first"], b["conv_id"]))
        got = list(prefix_trie.merged(iter([(b["run"], b["first"], b["conv_id"], b["body"]) for b in blocks])))
        assert [(p, c) for _, p, _, c in got] == sorted(rows)
        assert all(len(s) == len(p) for _, p, s, _ in got)
        for (_, a, _, _), (lcp, b, _, _) in zip(got, got[1:], strict=False):
            assert lcp == prefix_trie.common(a, b)


def test_merge_does_not_compare_shared_turns_again(monkeypatch):
    """Copies of a long conversation: each is compared once with the one before, not at every level of the tree."""
    steps = 0
    plain = prefix_trie.common

    def counted(a, b, start=0):
        nonlocal steps
        out = plain(a, b, start)
        steps += out - start
        return out

    path = [bytes([i]) * 16 for i in range(100)]
    blocks = [b for run in range(16) for b in prefix_trie._blocks(run, [(path, run + 16 * i, [1] * 100) for i in range(50)])]
    blocks.sort(key=lambda b: (b["first"], b["conv_id"]))
    monkeypatch.setattr(prefix_trie, "common", counted)
    assert len(list(prefix_trie.merged(iter([(b["run"], b["first"], b["conv_id"], b["body"]) for b in blocks])))) == 800
    # building the tree compares whole paths once a block and level; the 800 rows themselves cost nothing more
    assert steps < 100 * 16 * 40


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 230), 400, 405, 499, -3, -150, 7_000_000_000]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 8])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "bé", None])))
    for c in range(1000, 1160):  # copies
        rows += [(c, t, "user", "same \U0001f600") for t in range(4)]
    rows += [(1200, t, "user", "long") for t in range(300)] + [(1201, t, "user", "long") for t in range(290)]
    rows += [(5, None, "user", "first"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (5, 0, "assistant", "tie"), (None, 0, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("parts", ["1", "7"])
def test_trie(spark, tmp_path, parts):
    rows = conversations(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("clash")).withColumn("key", F.lit(1))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.op12_prefix_trie(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert sorted((tuple(r) for r in got), key=str) == plain_trie(plain_rebuilt(rows))


def test_trie_without_rows(spark):
    rows = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(rows))).collect() == []


def test_ids_are_hashed_in_chunks():
    rows = [("a", "1,2"), ("a", "30"), ("b", "4")]
    batch = pa.RecordBatch.from_pydict({"key": pa.array([k.encode() for k, _ in rows], pa.binary()), "ids": [i for _, i in rows]})
    got = [r for b in prefix_trie.hash_chunks(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert [(r["key"], r["ends_sha256"]) for r in got] == [(b"a", hashlib.sha256(b"1,2,30").hexdigest()), (b"b", hashlib.sha256(b"4").hexdigest())]


# --- op13 ---


def test_whole_tokens_are_proven():
    """Each string of the set is one token alone; each string left out is not, or stands for part of a character or several pre-tokens."""
    library, whole = Tokenizer.from_file(PATH), token_counts.whole_tokens(PATH)
    one = {t for t, e in zip(sorted(whole), library.encode_batch(sorted(whole), add_special_tokens=False), strict=True) if len(e.ids) == 1}
    assert one == whole and len(whole) > 45_000
    m = token_counts.merger(PATH)
    for latin in random.Random(1).sample(sorted(m.vocab), 3000):
        text = latin.encode("latin-1").decode(errors="replace")
        if text not in whole and "�" not in text:
            assert len(library.encode(text, add_special_tokens=False).ids) > 1 or len(m.pieces.findall(text)) > 1


def test_both_ways_of_merging_agree():
    m, rng = token_counts.merger(PATH), random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abeinorstÉ日́") for _ in range(rng.randint(1, 30))).encode()
        assert m._by_heap([m.bytes[b] for b in piece]) == m.tokens(piece)


def test_counts(spark):
    rows = list(enumerate(texts())) + [(99, None), (1, texts()[1]), (None, "x"), (2000, "word " * 1024), (2001, "word " * 1024 + "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = token_counts.count_tokens(docs, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 1024))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []
