"""A bounded, deterministic sample of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 12_000
FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of up to `rows` labelled documents outside fold 0: those of the smallest hashes of their ids."""
    picked = labels.where((fold(id_col) != 0) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64(id_col, F.lit(17)), id_col).limit(rows)
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), id_col).select("text", "y")  # at most `rows` rows
