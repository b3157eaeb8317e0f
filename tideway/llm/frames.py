"""What the operators share: row keys, batches, checkpoints, bounded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow batch may hold; texts of 100 kB then make 25 MB.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_key(text: str = "text") -> Column:
    """Tells rows of one id apart; rows equal in id and text may share it."""
    return F.xxhash64(F.col(text))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what spark.checkpoint.dir names. Only where driver and executors are one process may a folder of this machine stand in for it."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_written: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the folder that all executors share (smaller than checkpoint()). Inside `scratch` the table goes with it, else when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside go at its end, also if it fails; what is stored by the function it gives stays."""
    before = len(_written)
    kept: list[tuple[SparkSession, str]] = []

    def keep(df: DataFrame) -> DataFrame:
        out = stored(df)
        kept.append(_written[-1])
        return out

    try:
        yield keep
    finally:
        gone = [x for x in _written[before:] if x not in kept]
        _written[before:] = kept
        _delete(gone)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):  # the context may have ended
            context = spark.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _forget() -> None:
    _delete(_written)
