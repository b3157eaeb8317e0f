"""Readers: feeds, maps, trip files, envelopes. All schemas are fixed; what cannot be read is set aside, not fatal."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import iso_time, unzip_json_text

ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
# fixed values: which road classes may be driven, cycled and walked, and the tags that are kept
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "service")
CYCLABLE = ("cycleway",)
WALKABLE = ("footway", "pedestrian", "living_street", "path", "elevator", "escalator", "crossing", "platform", "steps")
TAGS = ("name", "highway", "sidewalk", "private", "bus", "cycleway", "oneway", "foot", "pedestrian", "turn")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of files below a path, in order of path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def json_any(spark: SparkSession, path, schema: T.StructType, array: bool = True) -> DataFrame:
    """JSON files, each one document, in a zip envelope or plain: (src_file, *fields). Payloads of another form (an error message for an array) give no rows."""
    # the metadata column exists on the scan only, so it is taken first
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("src_file"), "value")
    plain = raw.select("src_file", F.when(F.col("value").contains("base64(zip(o))"), unzip_json_text(F.col("value"))).otherwise(F.col("value")).alias("value"))
    if not array:
        return plain.select("src_file", F.from_json("value", schema).alias("o")).where("o is not null").select("src_file", "o.*")
    fit = plain.where(F.ltrim(F.col("value")).startswith("["))
    rows = fit.select("src_file", F.posexplode(F.from_json("value", T.ArrayType(schema))).alias("src_pos", "o"))
    return rows.where("o is not null").select("src_file", F.col("src_pos").cast("long").alias("src_pos"), "o.*")


def snapshots(spark: SparkSession, path, first: str | None = None, last: str | None = None) -> DataFrame:
    """Snapshot logs `{date}/{time}.json` to pings, pruned by the date in the file's name."""
    raw = json_any(spark, path, schemas.RAW_PING)
    day = F.regexp_extract("src_file", r"(\d{4}-?\d{2}-?\d{2})/[^/]*$", 1)
    day = F.regexp_replace(day, "-", "")
    if first:
        raw = raw.where(day >= first.replace("-", ""))
    if last:
        raw = raw.where(day <= last.replace("-", ""))
    return pings(raw)


def pings(raw: DataFrame) -> DataFrame:
    """Raw reports to the canonical table; the position is flat, statuses stay text (0 and '0' are one)."""
    return raw.select(
        F.col("PlateNumb").alias("plate"),
        F.coalesce("SubRouteUID", "RouteUID").alias("route_uid"),
        F.col("Direction").try_cast("int").alias("direction"),
        F.col("Speed").alias("speed_kph"),
        F.col("Azimuth").alias("azimuth_deg"),
        iso_time(F.col("GPSTime")).alias("gps_time"),
        F.col("BusPosition.PositionLat").alias("lat"),
        F.col("BusPosition.PositionLon").alias("lon"),
        F.col("BusStatus").alias("bus_status"),
        F.col("DutyStatus").alias("duty_status"),
        "src_file",
        "src_pos",
    ).where("plate is not null and gps_time is not null and lat is not null and lon is not null")


def stream_snapshots(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The same files as a stream, one array a file."""
    schema = T.StructType([f for f in schemas.RAW_PING.fields])
    raw = spark.readStream.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).json(path)
    return pings(raw.where("_corrupt_record is null").select("*", F.col("_metadata.file_path").alias("src_file"), F.lit(0).cast("long").alias("src_pos")))


def route_stops(raw: DataFrame) -> DataFrame:
    """StopOfRoute documents to the long table, by sequence."""
    s = raw.select(F.col("RouteUID").alias("route_uid"), F.col("SubRouteUID").alias("subroute_uid"), F.col("Direction").try_cast("int").alias("direction"), F.explode("Stops").alias("s"))
    return s.select("route_uid", "subroute_uid", "direction", F.col("s.StopSequence").alias("seq"), F.col("s.StopUID").alias("stop_uid"), F.col("s.StationID").alias("station_id"), F.col("s.StopName.Zh_tw").alias("name_zh"), F.col("s.StopName.En").alias("name_en"), F.col("s.StopPosition.PositionLat").alias("lat"), F.col("s.StopPosition.PositionLon").alias("lon"))


def bilingual_stops(spark: SparkSession, path) -> DataFrame:
    """Per-route files {en: [...], zh: [...]} to (src_file, lang, *stop)."""
    both = json_any(spark, path, schemas.RAW_BILINGUAL_STOPS, array=False)
    parts = [both.select("src_file", F.lit(lang).alias("lang"), F.inline(lang)) for lang in ("en", "zh")]
    return parts[0].unionByName(parts[1])


def osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations) of an OSM XML extract, by the built-in XML reader, one scan each."""

    def read(row_tag: str, ddl: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", row_tag).schema(ddl).load(path)

    tag = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
    tags = F.map_from_entries(F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])), F.array().cast("array<struct<k:string,v:string>>")))
    nodes = read("node", f"_id BIGINT, _lat DOUBLE, _lon DOUBLE, {tag}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags"))
    ways = read("way", f"_id BIGINT, nd ARRAY<STRUCT<_ref: BIGINT>>, {tag}").select(F.col("_id").alias("id"), tags.alias("tags"), F.col("nd._ref").alias("node_ids"))
    relations = read("relation", f"_id BIGINT, member ARRAY<STRUCT<_type: STRING, _ref: BIGINT, _role: STRING>>, {tag}")
    kind = lambda k: F.transform(F.filter("member", lambda m: m["_type"] == k), lambda m: m["_ref"]).alias(f"{k}s")
    return nodes, ways, relations.select(F.col("_id").alias("id"), tags.alias("tags"), kind("node"), kind("way"), kind("relation"))


def road_ways(ways: DataFrame, classes: Sequence[str] = ROAD_CLASSES) -> DataFrame:
    """Ways of the classes, with the tags that matter."""
    return ways.where(F.col("tags")["highway"].isin(*classes)).withColumn("tags", F.map_filter("tags", lambda k, v: k.isin(*TAGS)))


def supporting_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(ways.select(F.explode("node_ids").alias("id")).distinct(), "id", "left_semi")


def osm_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an `elements` document, alone in a zip or plain; an id that occurs twice raises."""
    ddl = "elements ARRAY<STRUCT<type: STRING, id: BIGINT, lat: DOUBLE, lon: DOUBLE, nodes: ARRAY<BIGINT>, tags: MAP<STRING, STRING>>>"
    files = spark.read.format("binaryFile").load(path).select("content")

    @F.pandas_udf("string")
    def text(contents: pd.Series) -> pd.Series:
        def one(c: bytes) -> str:
            if c[:2] == b"PK":
                with zipfile.ZipFile(io.BytesIO(c)) as z:
                    return z.read(z.namelist()[0]).decode()
            return c.decode()

        return contents.map(one)

    elements = files.select(F.explode(F.from_json(text("content"), ddl)["elements"]).alias("e")).select("e.*")
    nodes = elements.where("type = 'node'").select("id", "lat", "lon", "tags")
    ways = elements.where("type = 'way'").select("id", "tags", F.col("nodes").alias("node_ids"))
    for name, df in (("node", nodes), ("way", ways)):
        unique(df, "id", name)
    return nodes, ways


def unique(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, or an error if a key occurs twice."""
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} {twice[0][0]} occurs {twice[0]['n']} times")
    return df


def highway_classes(highways: DataFrame) -> DataFrame:
    """Observed classes to (highway, drivable, cyclable, walkable); true or null."""
    flag = lambda s, n: F.when(F.col("highway").isin(*s), F.lit(True)).alias(n)
    return highways.select("highway").where("highway is not null").distinct().select("highway", flag(DRIVABLE, "drivable"), flag(CYCLABLE, "cyclable"), flag(WALKABLE, "walkable"))


def highway_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The classes from CSV; blank is false."""
    df = spark.read.csv(path, header=True, schema="highway STRING, drivable STRING, cyclable STRING, walkable STRING")
    return df.select("highway", *[F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)).alias(c) for c in ("drivable", "cyclable", "walkable")])


def ways_of_kind(ways: DataFrame, matrix: DataFrame, kind: str) -> DataFrame:
    """Ways whose class is marked; the matrix has a row for each road class, a few dozen."""
    return ways.withColumn("highway", F.col("tags")["highway"]).join(F.broadcast(matrix.where(F.col(kind)).select("highway")), "highway").drop("highway")


def trip_csv(spark: SparkSession, path) -> DataFrame:
    """Trip files with a header; columns are read as text and cast by `plans.trips.clean`, so a changed file costs no second scan for types."""
    return spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)


def delimited_arrivals(text: Column) -> Column:
    """Payload records `stop_id_|_name_|_eta...` between @ to array<struct<stop, name, eta_s>>; what does not parse is left out."""
    records = F.split(text, "@")
    parsed = F.transform(records, lambda r: F.struct(F.regexp_extract(r, r"^([^|_]+)_?\|_?", 1).alias("stop"), F.regexp_extract(r, r"^[^|]+\|_?([^|_]+)_?\|", 1).alias("name"), F.regexp_extract(r, r"\|_?(-?\d+)\s*$", 1).try_cast("int").alias("eta_s")))
    return F.filter(parsed, lambda p: (p["stop"] != "") & p["eta_s"].isNotNull())


def arrivals(spark: SparkSession, path) -> DataFrame:
    """Arrivals by stop: (stop_name, route, direction, car, dept, dest, time_text)."""
    raw = json_any(spark, path, schemas.RAW_ARRIVALS)
    return raw.select(F.col("StopName").alias("stop_name"), F.explode("Info").alias("i")).select("stop_name", F.col("i.PathName").alias("route"), F.col("i.Goback").try_cast("int").alias("direction"), F.col("i.Car").alias("car"), F.col("i.Dept").alias("dept"), F.col("i.Dest").alias("dest"), F.col("i.Time").alias("time_text"))


def vehicle_positions(spark: SparkSession, path) -> DataFrame:
    """Positions whose numbers are text."""
    raw = json_any(spark, path, schemas.RAW_VEHICLE_POSITIONS)
    return raw.select(F.col("BusID").alias("plate"), F.col("RouteID").alias("route_uid"), F.col("GoBack").try_cast("int").alias("direction"), *[F.col(c).try_cast("double").alias(n) for c, n in (("Latitude", "lat"), ("Longitude", "lon"), ("Azimuth", "azimuth_deg"))])


def live_stops(spark: SparkSession, path) -> DataFrame:
    """Stops of a route in order; the sequence is text in the feed."""
    raw = json_any(spark, path, schemas.RAW_LIVE_STOPS)
    return raw.select("src_file", F.col("SID").alias("sid"), F.col("nameZh").alias("name_zh"), F.col("seqNo").try_cast("int").alias("seq"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon")).orderBy("src_file", "seq")


def graph(spark: SparkSession, path: str, largest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as written by `sinks.write_graph`, cut to the largest strongly connected component."""
    nodes, edges = spark.read.schema(schemas.NODES).parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if largest:
        from ..operators.graph import induced, largest_component

        keep = largest_component(edges)
        return nodes.join(keep, "id", "left_semi"), induced(edges, keep)
    return nodes, edges


def query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL over named frames."""
    return spark.sql(sql, **views)
