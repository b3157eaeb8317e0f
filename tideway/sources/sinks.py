"""Writers: tables, envelopes, GPX, checkpoints of rounds, upserts. A job that is run again skips what is done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import zip_json_text


def write_enveloped(df: DataFrame, path: str, key: str | None = None) -> None:
    """A JSON envelope a row (a group, if key is set), as lines of text."""
    packed = df.select(F.to_json(F.struct(*df.columns)).alias("j")) if key is None else df.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key])))).alias("j"))
    packed.select(zip_json_text("j").alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def recompress(spark: SparkSession, source: str, target: str) -> None:
    """Plain and enveloped text files to one compressed table of (src_file, value); files that are there already are not read again."""
    raw = spark.read.format("text").option("wholetext", "true").load(source).select(F.col("_metadata.file_path").alias("src_file"), "value")
    try:
        raw = raw.join(spark.read.parquet(target).select("src_file"), "src_file", "left_anti")
    except Exception as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    raw.write.mode("append").option("compression", "zstd").parquet(target)


def write_by(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """Partitioned by keys. Rows are dealt by the keys and a salt, so a large key is written by several tasks."""
    df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode(mode).partitionBy(*keys).parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.select("id", "lat", "lon").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def unfinished(keys: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.join(done.select(*on).distinct(), list(on), "left_anti")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "false").csv(path)


def replace_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_round(metric: DataFrame, manifest: str, path: str, weekday: int, hour: int, round_: int) -> None:
    """A round's table, then a row of the manifest that marks it valid: a job that dies between leaves no valid row."""
    metric.withColumns({"weekday": F.lit(weekday), "hour": F.lit(hour), "round": F.lit(round_)}).write.mode("overwrite").parquet(f"{path}/weekday={weekday}/hour={hour}/round={round_}")
    metric.sparkSession.createDataFrame([(weekday, hour, round_, True, False)], "weekday int, hour int, round int, valid boolean, locked boolean").write.mode("append").parquet(manifest)


def _xml(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def gpx(waypoints: Column, segments: Column) -> Column:
    """A GPX document: waypoints array<struct<lat, lon, name>>, segments array<array<struct<lat, lon>>>; null if both are null."""
    at = lambda tag, p: F.concat(F.lit(f'<{tag} lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('"'))
    wpt = F.array_join(F.transform(F.coalesce(waypoints, F.array().cast("array<struct<lat:double,lon:double,name:string>>")), lambda p: F.concat(at("wpt", p), F.lit("><name>"), _xml(p["name"]), F.lit("</name></wpt>"))), "")
    trk = F.array_join(F.transform(F.coalesce(segments, F.array().cast("array<array<struct<lat:double,lon:double>>>")), lambda s: F.concat(F.lit("<trkseg>"), F.array_join(F.transform(s, lambda p: F.concat(at("trkpt", p), F.lit("/>"))), ""), F.lit("</trkseg>"))), "")
    doc = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="tideway" xmlns="http://www.topografix.com/GPX/1/1">'), wpt, F.lit("<trk>"), trk, F.lit("</trk></gpx>"))
    return F.when(waypoints.isNotNull() | segments.isNotNull(), doc)
