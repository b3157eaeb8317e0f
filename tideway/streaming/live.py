"""Streaming twins of the batch operators.

Event times are cast to timestamps first: a watermark cannot sit on a timestamp without zone.
Reports later than the watermark are dropped, which the batch path does not do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(df: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def sessions_by_gap(df: DataFrame, key: str, time: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) by gap alone; events exactly one gap apart are one session."""
    return timed(df, time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_resends(df: DataFrame, key: str, time: str, indicators: list[str], delay: str = "10 minutes") -> DataFrame:
    """Reports sent twice go; one of the same time with another indicator is no resend and stays."""
    return timed(df, time, delay).dropDuplicatesWithinWatermark([key, time, *indicators])


_STATE = "last_us long, segment long, indicators string, n long, start_us long, waiting string"
_OUT = "key string, segment long, start timestamp, end timestamp, n long"


def segments(df: DataFrame, key: str, time: str, indicators: list[str], gap_s: int = 300, delay: str = "10 minutes") -> DataFrame:
    """Closed segments (key, segment, start, end, n): cut by a change of an indicator or a gap.

    A row waits in the state of its key until the watermark has passed it, so that rows are cut in order of
    time whatever batch brings them. The open segment is closed by an event-time timer when the gap has passed.
    """
    gap_ms = gap_s * 1_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last, number, now, n, start, waiting = state.get if state.exists else (0, 0, "", 0, 0, "[]")
        rows = json.loads(waiting)
        if not state.hasTimedOut:
            for f in frames:
                rows += zip(f._us.tolist(), f._ind.tolist(), strict=True)
        rows = sorted(map(tuple, rows))
        passed = state.getCurrentWatermarkMs()

        def close():
            if n:
                out.append((k[0], number, pd.Timestamp(start, unit="us"), pd.Timestamp(last, unit="us"), n))

        settled = [r for r in rows if r[0] // 1000 < passed]
        for us, ind in settled:
            if not n or ind != now or us - last > gap_ms * 1000:
                close()
                last, number, now, n, start = us, number + 1, ind, 1, us
            elif us > last:
                last, n = us, n + 1
        if n and last // 1000 + gap_ms < passed:
            close()
            n = 0  # the number goes on, so that later segments of the key are told apart
        rest = rows[len(settled) :]
        state.update((last, number, now, n, start, json.dumps(rest)))
        timers = [r[0] // 1000 + 1 for r in rest[:1]] + [last // 1000 + gap_ms + 1] * bool(n)
        if timers:
            state.setTimeoutTimestamp(max(min(timers), passed + 1))
        yield pd.DataFrame(out, columns=["key", "segment", "start", "end", "n"])

    tagged = timed(df, time, delay).select(F.col(key).cast("string").alias("key"), F.col(time), F.unix_micros(time).alias("_us"), F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(c) for c in indicators])).alias("_ind"))
    return tagged.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def with_static(stream: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """A live feed against a table that each micro-batch reads afresh."""
    return stream.join(table, on, "left")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a shared folder, made if it is not there."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(context._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    return fs, where


def _names(fs, where) -> list[str]:
    return sorted(x.getPath().getName() for x in fs.listStatus(where))


def _mark(spark: SparkSession, fs, path: str) -> None:
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), False).close()


def upsert_sink(apply: Callable[[DataFrame, int], None], folder: str):
    """foreachBatch function that applies a batch once, also if it is delivered again after a restart: finished batches leave a mark in the folder, which belongs to one checkpoint. A batch that failed half-way is applied again."""

    def run(batch: DataFrame, number: int) -> None:
        fs, where = _folder(batch.sparkSession, folder)
        name = f"batch-{number:020d}"
        if name not in _names(fs, where):
            apply(batch, number)
            _mark(batch.sparkSession, fs, f"{folder}/{name}")

    return run


def calendar(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that the last pointer of a `calendar_sink` names; None before the first batch."""
    names = _names(*_folder(spark, f"{path}/pointers"))
    return spark.read.parquet(f"{path}/tables/{names[-1].split('.')[-1]}") if names else None


def calendar_sink(path: str, keys: list[str], now, end: str = "end_time", margin_s: float = 0, stream: str = "stream"):
    """Each batch replaces events of its keys in the table at path and drops those that are over.

    A batch writes a table of its own and then a pointer to it; the last pointer counts, so readers (`calendar`)
    never see half a table, and a batch that is delivered again is left out. `stream` names the checkpoint:
    another one goes on from the same table. A pointer whose table is gone is an error.
    """
    from ..operators.joins import expire, upsert

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, where = _folder(spark, f"{path}/pointers")
        names = _names(fs, where)
        if any(x.split(".")[1:3] == [stream, str(number)] for x in names):
            return
        old = calendar(spark, path)
        kept = batch if old is None else upsert(old, batch, keys)
        table = uuid.uuid4().hex
        expire(kept, end, now, margin_s).write.parquet(f"{path}/tables/{table}")
        _mark(spark, fs, f"{path}/pointers/{len(names):020d}.{stream}.{number}.{table}")

    return run


def progress(query) -> dict:
    """Rows and durations of the last micro-batch."""
    p = query.lastProgress
    return {} if p is None else {"batch": p["batchId"], "rows": p["numInputRows"], "ms": dict(p["durationMs"])}
