"""The pipeline's stages one by one, and as a whole on a small fixture against plain versions."""

import brute
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tideway.llm import pii

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def test_pipeline(spark, tmp_path):
    prose = lambda k, n=40: " ".join(WORDS[(i * k + i * i) % 12] + str((i * k) % 7) for i in range(n))
    rows = [(i, prose(i + 2)) for i in range(30)]
    rows += [(100 + i, f"{prose(i + 40)} scum moron") for i in range(30)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(300, rows[4][1]), (301, rows[4][1] + " tail"), (302, prose(90) + " " + item), (303, "write to me@example.org now " + prose(91)), (304, None), (305, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, int("scum" in (t or ""))) for d, t in rows[:60]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == list(corpus_pipeline.COLUMNS), name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = [(d, t) for d, t in rows if "scum" not in (t or "")]
    kept = {d for d, _, _, k in brute.near_dedup(clean, 80) if k}
    left = [(d, t) for d, t in clean if d in kept]
    dirty = {d for d, *_, c in brute.decontamination(left, [(1, item)]) if c}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: library.encode(pii.redact(t or "", pii.base_spans(t or "")), add_special_tokens=False).ids for d, t in left if d not in dirty}
    assert {d: r.ids for d, r in got.items()} == want
    assert 302 not in got and 300 not in got and 303 in got and 304 in got


def test_stages_without_documents_and_with_other_columns(spark, tmp_path):
    rows = [(1, None, None, None, None, "x"), (1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "one two me@example.org", "en", "s", 22, "x"), (None, "three", "en", "s", 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([(3, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        none, some = stage(spark, docs.limit(0), str(tmp_path)), stage(spark, docs, str(tmp_path))
        assert none.count() == 0, name
        if name == "bpe":
            assert sorted(r.n_tokens for r in some.collect())[:3] == [0, 0, 0] and some.count() == 5
            continue
        assert some.columns == none.columns == list(corpus_pipeline.COLUMNS), name
        assert some.count() == 5, name
