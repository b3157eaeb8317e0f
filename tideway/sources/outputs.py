"""Several outputs of the same results, each of which may fail by itself; a rerun writes what is missing.

A kind of output is written as a table (key, content) of its own attempt; after it a mark (key, kind, state, attempt) for every key goes
to the ledger. Only content with the mark of its own attempt counts, so an attempt that died half-way leaves nothing behind that is read.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
LEDGER = "key string, kind string, state string, attempt string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, kind, state, attempt) of all attempts; empty before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def write_outputs(results: DataFrame, key: str, kinds: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> dict[str, str | None]:
    """Writes each kind for the results that lack it, and says of each what went wrong (None: nothing).

    A kind's function takes the results left to do and gives (key, content), content a text. A result without content, or with null, is marked as failed and
    tried again by the next run, as are all of a kind whose function or job raised; other kinds go on. Equal keys are one result, of which one stays; null keys have no
    output.
    """
    spark = results.sparkSession
    problems: dict[str, str | None] = {}
    named = results.where(F.col(key).isNotNull()).dropDuplicates([key])
    for kind, make in kinds.items():
        attempt = uuid.uuid4().hex
        where = f"{path}/content/kind={kind}/attempt={attempt}"
        try:
            done = ledger(spark, path).where((F.col("kind") == kind) & (F.col("state") == "done")).select(F.col("key").alias("_done"))
            left = named.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti")
            made = make(left).select(F.col(key).cast("string").alias("key"), F.col("content").cast("string").alias("content"))
            made.where("content is not null").dropDuplicates(["key"]).write.parquet(where)
            got = spark.read.schema("key string, content string").parquet(where).select("key", F.lit("done").alias("state"))
            marks = left.select(F.col(key).cast("string").alias("key")).join(got, "key", "left")
            marks.select("key", F.lit(kind).alias("kind"), F.coalesce("state", F.lit("failed")).alias("state"), F.lit(attempt).alias("attempt")).write.mode("append").parquet(f"{path}/ledger")
            failed = ledger(spark, path).where((F.col("attempt") == attempt) & (F.col("state") == "failed")).count()
            problems[kind] = f"{failed} results without output" if failed else None
        except Exception as e:  # of whatever sort: the other kinds are to be written
            problems[kind] = str(e) or type(e).__name__
        if problems[kind]:
            log.warning("%s: %s", kind, problems[kind][:300])
    return problems


def outputs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, content) of a kind, of the attempts that count."""
    done = ledger(spark, path).where((F.col("kind") == kind) & (F.col("state") == "done")).select("key", "attempt")
    try:
        found = spark.read.schema("key string, content string, attempt string").parquet(f"{path}/content/kind={kind}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], "key string, content string, attempt string")
    return found.join(done, ["key", "attempt"], "left_semi").select("key", "content")
