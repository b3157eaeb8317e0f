"""Tables that are made once: a cache named by a fingerprint of its inputs, with the places among them stored by tile.

A build writes its tables to a folder of its own, and at the end a list of its files and their sizes. A build counts if that list is
there and every file of it is there in its size; so a job that died half-way, or a file that was cut, leads to a new build and to
no error. Sources are only listed, not read, to see whether they have changed.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..frames import scratch, written
from ..functions import geo

#: Bits of a place's code for each axis; the most of them that name its tile (1.4 by 0.7 degrees); rows of a tile, if they lay evenly on the globe.
BITS, TILE_BITS, TILE_ROWS = 16, 8, 100_000


@dataclass(frozen=True)
class Cached:
    """tables by name, `built`: whether this call made them, `folder`: where they are."""

    tables: dict[str, DataFrame]
    built: bool
    folder: str


def fingerprint(spark: SparkSession, inputs: Sequence[str], version: str = "") -> str:
    """Of the names, sizes and times of all files below the inputs, and a version of the code. The files are listed and not opened; no list of them comes to this program. An input without files counts as empty, one that is not there raises."""
    found = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    for path in inputs:
        found = found.unionAll(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime"))
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)")).cast("string")
    row = found.distinct().agg(F.count("*").cast("string"), h(0), h(1)).first()
    return hashlib.sha256(json.dumps([sorted(inputs), version, *row]).encode()).hexdigest()[:32]


def place_code(lat: Column, lon: Column, bits: int = BITS) -> Column:
    """The place along a space-filling curve over the globe; null places get null."""
    at = lambda c, low, width: F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor((c - low) / width * (1 << bits)))).cast("long")
    spread = lambda c, k: F.shiftleft(F.shiftright(c, k).bitwiseAND(1), 2 * k)
    x, y = at(lon, -180.0, 360.0), at(lat, -90.0, 180.0)
    return F.when(lat.isNotNull() & lon.isNotNull(), sum((spread(x, k) + 2 * spread(y, k) for k in range(bits)), F.lit(0).cast("long")))


def by_place(df: DataFrame, bits: int) -> DataFrame:
    """df (lat, lon, ...) with its `tile` of so many bits an axis, which the column's metadata tells, dealt and sorted along the curve: a crowded tile is written by several tasks, and a file holds places near each other."""
    code = place_code(F.col("lat"), F.col("lon"))
    tile = F.coalesce(F.shiftright("_code", 2 * (BITS - bits)), F.lit(-1)).alias("tile", metadata={"bits": bits})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c != "tile"]
    return df.withColumn("_code", code).repartitionByRange(n, "_code", *rest[:1]).sortWithinPartitions("_code").select(*rest, tile)


def tile_bits(rows: int, tile_rows: int = TILE_ROWS) -> int:
    return max(0, min(TILE_BITS, math.ceil(math.log(max(rows, 1) / tile_rows, 4))))


def _files(spark: SparkSession, path: str):
    """(file system, {relative name: size}) below a folder; no files if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return fs, {}
    base, found, out = fs.makeQualified(at).toString().rstrip("/") + "/", fs.listFiles(at, True), {}
    while found.hasNext():
        f = found.next()
        out[f.getPath().toString().removeprefix(base)] = f.getLen()
    return fs, out


def _listed(names: dict[str, int], folder: str) -> dict[str, int]:
    """The data files of a build by name, among those below the cache."""
    return {n: s for n, s in names.items() if n.startswith(f"{folder}/tables/") and n.endswith(".parquet")}


def _complete(spark: SparkSession, path: str, names: dict[str, int], folder: str) -> dict | None:
    """The list of a build, if it counts."""
    if f"{folder}/files.json" not in names:
        return None
    text = spark.read.option("wholetext", "true").text(f"{path}/{folder}/files.json").first()
    try:
        listed = json.loads(text[0])
    except (TypeError, json.JSONDecodeError):  # cut itself
        return None
    return listed if listed["files"] == _listed(names, folder) else None


def cached(spark: SparkSession, path: str, make: Callable[[], dict[str, DataFrame]], inputs: Sequence[str], version: str = "", places: Sequence[str] = (), recompute: bool = False, tile_rows: int = TILE_ROWS) -> Cached:
    """The tables that `make` gives, from the cache at path if a build of the same inputs and version is whole; else, or to recompute, they are made and stored. The tables named in `places` (with lat, lon) are stored by tile.

    The latest whole build counts. Builds that do not count are removed when a new one of the same fingerprint is whole, so two programs should not
    build the same at once; whole ones stay, as others may be reading them. A table without rows keeps its schema.
    """
    name = fingerprint(spark, inputs, json.dumps([version, sorted(places), tile_rows]))
    fs, names = _files(spark, path)
    builds = sorted({n.split("/")[0] for n in names if n.startswith(f"{name}-")})
    whole = [(k["number"], b, k) for b in builds if (k := _complete(spark, path, names, b)) is not None]
    built = recompute or not whole
    if built:
        folder = f"{name}-{uuid.uuid4().hex}"
        schemas = {}
        for table, df in make().items():
            with scratch():
                if table in places:  # a copy first: it is counted, and sampled for its ranges
                    df = written(df)
                    df = by_place(df, tile_bits(df.count(), tile_rows))
                writer = df.write.partitionBy("tile") if table in places else df.write
                writer.parquet(f"{path}/{folder}/tables/{table}")
                schemas[table] = df.schema.json()
        listed = {"number": 1 + max((w[0] for w in whole), default=0), "schemas": schemas, "files": _listed(_files(spark, path)[1], folder)}
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/files.json"), True)
        out.write(bytearray(json.dumps(listed).encode()))
        out.close()
        for b in set(builds) - {w[1] for w in whole}:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{b}"), True)
    else:
        _, folder, listed = max(whole, key=lambda w: w[0])

    def read(t: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(listed["schemas"][t]))
        df = spark.read.schema(schema).parquet(f"{path}/{folder}/tables/{t}")
        return df.withMetadata("tile", schema["tile"].metadata) if t in places else df  # the reader forgets what it is told of a partition's column

    return Cached({t: read(t) for t in listed["schemas"]}, built, f"{path}/{folder}")


def in_box(index: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """The rows of a table stored by tile in a box that does not cross the date line. Only the box's tiles are read; the bounds go to the scan too."""
    bits = index.schema["tile"].metadata["bits"]
    tile = lambda c, low, width: max(0, min((1 << bits) - 1, int((c - low) / width * (1 << bits))))
    ys = range(tile(south, -90.0, 180.0), tile(north, -90.0, 180.0) + 1)
    xs = range(tile(west, -180.0, 360.0), tile(east, -180.0, 360.0) + 1)
    out = index.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if len(ys) * len(xs) > 256:  # more tiles than are worth naming; the bounds still are at the scan
        return out
    code = lambda x, y: sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))
    return out.where(f"tile in ({', '.join(str(code(x, y)) for y in ys for x in xs)})")


def nearest_stored(index: DataFrame, lat: float, lon: float, k: int = 10, start_m: float = 500.0, id_: str = "id") -> DataFrame:
    """The k rows nearest to one position, with dist_m and rank, ties to the smaller id: the box around it doubles until k rows are surely nearest, so that only the tiles around it are read. Fewer than k only if the table has no more."""
    if k < 1:
        raise ValueError("at least one")
    dist = geo.great_circle(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    r = start_m
    while True:
        d_lat = r / 110_500.0  # a degree of latitude is never shorter
        north, south = lat + d_lat, lat - d_lat
        shortest = math.cos(math.radians(max(abs(north), abs(south)))) if max(abs(north), abs(south)) < 89 else 0.0
        d_lon = d_lat / shortest if shortest > 0 else 360.0
        whole = d_lon >= 180 or lon - d_lon < -180 or lon + d_lon > 180  # the box meets a pole or the date line: all longitudes
        box = in_box(index, max(-90.0, south), min(90.0, north), -180.0 if whole else lon - d_lon, 180.0 if whole else lon + d_lon)
        near = box.withColumn("dist_m", dist)
        everything = south <= -90 and north >= 90
        if everything or near.where(F.col("dist_m") <= r).limit(k).count() == k:
            best = near.where("dist_m is not null").orderBy("dist_m", id_).limit(k)
            return best.withColumn("rank", F.row_number().over(W.orderBy("dist_m", id_)))  # of k rows
        r *= 2
