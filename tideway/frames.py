"""Lineage cuts that survive a lost executor."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> None:
    """Sees to it that the context has a checkpoint folder that all executors share. Only where driver and executors are one process may a folder of this machine stand in for it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(found)


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of this context."""
    _folder(df)
    return df.sparkSession.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """A copy in the shared checkpoint folder."""
    _folder(df)
    return df.checkpoint(eager=True)


#: The tables that each open `scratch` has seen written, innermost last.
_scopes: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """A Parquet copy in the shared checkpoint folder. For loops of many rounds: plans of the next rounds know its true size and nothing of how it was made. Inside `scratch` it goes with it, else it stays until the folder goes."""
    _folder(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scopes:
        out._path = path
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside go at its end, also if it fails; what the function it gives has written stays, or belongs to the scope around it."""
    mine: list[DataFrame] = []
    _scopes.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = written(df)
        mine.pop()
        if len(_scopes) > 1:
            _scopes[-2].append(out)
        return out

    try:
        yield keep
    finally:
        _scopes.pop()
        for df in mine:
            _delete(df, df._path)


def _delete(df: DataFrame, path: str) -> None:
    with contextlib.suppress(Exception):  # the context may have ended
        context = df.sparkSession.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
