import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from tideway.llm import bpe, chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "'s", "'", "ll", "a", "aa", "the", "The", "1", "²", "Ⅷ", "é", "日本", "🙂", "#", "--", "<|endoftext|>", "<|", "\x00", "ß", "ा", "_", "\u0301"]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    return [*out, "a" * 3_000, "".join(rng.choice("abeinorst") for _ in range(3_000)), "", "<|endoftext|>" * 3]


def test_encoder_equals_the_library(monkeypatch):
    library, ours = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    monkeypatch.setattr(bpe, "GENERATION", 2_000)
    for t, e in zip(texts(), library.encode_batch(texts(), add_special_tokens=False), strict=True):
        ids = ours.encode(t)
        assert np.frombuffer(ids, np.uint32).tolist() == e.ids
        assert ours.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == t


@pytest.mark.parametrize("with_ids", [True, False])
def test_documents(spark, with_ids):
    rows = list(enumerate(texts()[:50])) + [(99, None), (1, texts()[1]), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = bpe.encode_documents(docs, PATH, with_ids=with_ids).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or "")))
        if with_ids:
            assert any(r.ids == ids for r in got)
    assert sorted((str(r.id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_chat_round_trip(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[INST] ", " [/INST] ", "\\", "<", "[", "<\\s>", "<\\\\/s>", "s>", "x", "\n", "é", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "</s>", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for c in range(40) for t in range(rng.randint(1, 40))]
    rows += [(0, 0, "user", "tie"), (50, 7, "assistant", ""), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit(1))
    got = {r.conv_id: r for r in chat.format_conversations(df).select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or ""))]
        assert [(t.role, t.text) for t in got[c].turns] == want
        masked = [got[c].formatted[s.start : s.end] for s in got[c].loss_spans]
        plain = spark.createDataFrame([(m,) for m in masked], "m string").select(chat.unescape(F.col("m"))).collect() if c in (0, -7, 50) else None
        if plain is not None:
            assert [p[0] for p in plain] == [t for r, t in want if r == "assistant"]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_best_branch(spark):
    tree = [("t", 1, None, 1.0), ("t", 2, 1, 0.0), ("t", 3, 1, 0.5), ("t", 4, 2, 2.0), ("t", 5, 3, 1.0), ("t", 6, 5, 1.0), ("u", 7, 99, 0.0)]
    nodes = spark.createDataFrame(tree, "tree string, id long, parent long, score double")
    got = chat.paths(nodes, None).groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "id"))).alias("p")).collect()
    assert {(r.tree, r["rank"]): [x["id"] for x in r.p] for r in got} == {("t", 1): [1, 3, 5, 6], ("t", 2): [1, 2, 4], ("u", 1): [7]}
    long = spark.createDataFrame([("v", i, i - 1 if i else None, 0.0) for i in range(70)], nodes.schema)
    assert [r.id for r in chat.paths(long).orderBy("depth").collect()] == list(range(70))
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([("w", 1, 2, 0.0), ("w", 2, 1, 0.0)], nodes.schema))


def test_op10_reads_the_loss_mask(spark, tmp_path, monkeypatch):
    """The loss columns are of the text under the mask: a wrong mask shows in them."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ñ <s> [/INST] \U0001f600"), (1, 2, "assistant", "b"), (2, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.loss_chars, r.loss_sha256) for r in queries.op10_chat(spark, str(tmp_path)).collect()}
    want = {1: rows[1][3] + "b", 2: "", -7: "</s>[INST] ok [/INST]"}
    assert got == {c: (len(t), hashlib.sha256(t.encode()).hexdigest()) for c, t in want.items()}
    right = chat.format_conversations
    monkeypatch.setattr(chat, "format_conversations", lambda rows: right(rows).withColumn("loss_spans", F.slice("loss_spans", 1, 0)))
    assert {r.loss_chars for r in queries.op10_chat(spark, str(tmp_path)).collect()} == {0}
