"""Reads and streams that say what they met: rows, files that could not be read, a limit that was hit; progress at most once in a period."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..functions.text import unzip_json_text

log = logging.getLogger(__name__)


@dataclass
class Watch:
    """What an action on the table saw. `report` waits for the first action to end, so ask after it; rules name a text for figures that call for a warning."""

    seen: Observation
    rules: list[Callable[[dict], str | None]] = field(default_factory=list)

    def report(self) -> dict:
        """The figures; what calls for a warning is logged."""
        found = self.seen.get
        for rule in self.rules:
            if text := rule(found):
                log.warning(text)
        return found


def _documents(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("src_file"), "value")
    return raw.select("src_file", F.when(F.col("value").contains("base64(zip(o))"), unzip_json_text(F.col("value"))).otherwise(F.col("value")).alias("value"))


def _readable():
    # the length of what is no JSON array is null; a document that is JSON of another form is an answer with an error in it
    return F.json_array_length("value").isNotNull()


def reports(spark: SparkSession, path, schema: T.StructType | str) -> tuple[DataFrame, Watch]:
    """JSON arrays in files, plain or enveloped, to ((src_file, src_pos, *fields), Watch): files, undecodable and empty ones are counted by the same pass, and undecodable ones warned of. They give no rows and stop nothing."""
    fields = T._parse_datatype_string(str(schema)) if isinstance(schema, str) else schema
    seen = Observation()
    bad = ~_readable()
    counted = _documents(spark, path).observe(seen, F.count("*").alias("files"), F.count_if(bad).alias("undecodable"), F.min(F.when(bad, F.col("src_file"))).alias("first_undecodable"))
    rows = counted.where(_readable()).select("src_file", F.posexplode(F.from_json("value", T.ArrayType(fields))).alias("src_pos", "o")).where("o is not null")
    warn = lambda f: f"{f['undecodable']} of {f['files']} files could not be read, such as {f['first_undecodable']}" if f["undecodable"] else None
    return rows.select("src_file", F.col("src_pos").cast("long").alias("src_pos"), "o.*"), Watch(seen, [warn])


def undecodable(spark: SparkSession, path) -> DataFrame:
    """(src_file, problem) of the files below a path that are no JSON array: 'empty', 'not an array' or 'not JSON'."""
    problem = F.when(F.coalesce(F.trim("value"), F.lit("")) == "", "empty").when(F.get_json_object("value", "$").isNotNull(), "not an array").otherwise("not JSON")
    return _documents(spark, path).where(~_readable()).select("src_file", problem.alias("problem"))


def limited(df: DataFrame, limit: int, what: str = "rows") -> tuple[DataFrame, Watch]:
    """(The first `limit` rows, Watch): it counts them and warns if there were as many as the limit, as more may have been left out."""
    seen = Observation()
    out = df.limit(limit).observe(seen, F.count("*").alias("rows"))
    return out, Watch(seen, [lambda f: f"limit hit ({f['rows']} {what})" if f["rows"] >= limit else None])


class Throttled(StreamingQueryListener):
    """Hands the progress of streams to `write`, as a dict, at most once in `every_s` seconds for each query; the last one held back is written when its query ends. A `write` that fails is logged and stops nothing."""

    def __init__(self, write: Callable[[dict], None], every_s: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.write, self.every_s, self.clock = write, every_s, clock
        self.due: dict[str, float] = {}
        self.held: dict[str, dict] = {}

    def offer(self, query: str, progress: dict) -> bool:
        """Whether it was written."""
        now = self.clock()
        if now < self.due.get(query, now):
            self.held[query] = progress
            return False
        self.held.pop(query, None)
        self.due[query] = now + self.every_s
        self._write(progress)
        return True

    def _write(self, progress: dict) -> None:
        try:
            self.write(progress)
        except Exception as e:
            log.warning("progress was not written: %s", e)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.offer(p["runId"], {"batch": p["batchId"], "rows": p["numInputRows"], "ms": p.get("durationMs", {})})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        key = str(event.runId)
        self.due.pop(key, None)
        if (last := self.held.pop(key, None)) is not None:
            self._write(last)
