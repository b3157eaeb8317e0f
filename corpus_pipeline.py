"""From raw documents to token ids: five stages, each over all that its predecessor kept.

Every stage but the last takes and returns the columns of documents, in COLUMNS; other columns go. No documents
give no documents. Null and empty texts are clean and unlike anything, so they pass every filter; redaction
makes a null text an empty one. Repeated rows are judged alike, and near_dedup keeps one of them (all of the blank
ones). A null id is an id like any other, but comes last where the smallest id stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm import bpe, decontamination, minhash, pii, toxicity
from tideway.llm.frames import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at one half or more go; without labels of both kinds none but by their share."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    if not len(model[0]):
        return docs.select(*COLUMNS)
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select("kept.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the smallest id stays; documents without words stay all."""
    return minhash.keep_one(docs.select(*COLUMNS), percent=80, shingle=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark windows go; documents without words stay."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), keep=COLUMNS)
    return found.where("not contaminated").select("kept.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data gives way to its kind; n_chars is counted anew."""
    found = pii.extract(docs, keep=COLUMNS[:1] + COLUMNS[2:4])
    return found.select("kept.doc_id", F.col("redacted").alias("text"), "kept.lang", "kept.source", F.char_length("redacted").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids_sha256, decoded_sha256, ids; none for an empty text."""
    return bpe.encode_documents(docs, TOKENIZER, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: Models and tokenising are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
