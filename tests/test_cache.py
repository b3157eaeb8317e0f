"""The cache of tables: what makes it build again, and the nearest of stored places against all distances."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideway.functions import geo
from tideway.sources import cache


@pytest.fixture
def network(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.uniform(-20, 30), rng.uniform(100, 150), f"n{i}") for i in range(400)] + [(400 + i, 22.5, 120.25, "same") for i in range(30)] + [(900, None, 1.0, "nowhere")]
    source = str(tmp_path / "source")
    spark.createDataFrame(rows, "id long, lat double, lon double, name string").write.parquet(source)
    calls = []

    def make():
        calls.append(1)
        stops = spark.read.parquet(source)
        return {"stops": stops, "names": stops.groupBy("name").agg(F.count("*").alias("n")), "none": stops.limit(0)}

    return lambda **more: cache.cached(spark, str(tmp_path / "cache"), make, [source], places=("stops",), tile_rows=4, **more), calls, rows, source


def test_built_once(spark, network, tmp_path):
    get, calls, rows, source = network
    first = get()
    again = get()
    assert (first.built, again.built, len(calls)) == (True, False, 1) and first.folder == again.folder
    assert sorted((r.id, r.lat, r.lon, r.name) for r in again.tables["stops"].collect()) == sorted(rows, key=lambda r: r[0])
    assert again.tables["none"].columns == ["id", "lat", "lon", "name"] and again.tables["none"].count() == 0
    assert again.tables["names"].where("name = 'same'").first().n == 30
    assert get(recompute=True).built and len(calls) == 2
    latest = get()
    assert not latest.built and latest.folder != first.folder
    assert get(version="2").built and len(calls) == 3
    spark.range(1).selectExpr("id", "0D lat", "0D lon", "'new' name").write.mode("append").parquet(source)
    changed = get()
    assert changed.built and changed.tables["stops"].count() == len(rows) + 1 and len(calls) == 4


@pytest.mark.parametrize("harm", ["cut", "gone", "no list", "cut list"])
def test_rebuilt_after_harm(network, harm):
    get, calls, rows, _ = network
    folder = Path(get().folder)
    data = sorted(folder.glob("tables/stops/*/*.parquet"))[0]
    for f in (data, folder / "files.json"):  # no checksum files in the way
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    if harm == "cut":
        data.write_bytes(data.read_bytes()[:50])
    elif harm == "gone":
        data.unlink()
    elif harm == "no list":
        (folder / "files.json").unlink()
    else:
        (folder / "files.json").write_text((folder / "files.json").read_text()[:20])
    again = get()
    assert again.built and len(calls) == 2 and again.tables["stops"].count() == len(rows) and not folder.exists()
    assert not get().built


def test_nearest_stored(spark, network):
    get, _, rows, _ = network
    stops = get().tables["stops"]
    for lat, lon, k, start in ((22.5, 120.25, 12, 500.0), (0.0, 125.0, 5, 1e5), (-89.5, 10.0, 3, 3e6), (80.0, 179.9, 450, 5e6)):
        got = [(r.id, r["rank"]) for r in cache.nearest_stored(stops, lat, lon, k, start).orderBy("rank").collect()]
        far = spark.createDataFrame([r for r in rows if r[1] is not None], "id long, lat double, lon double, name string").withColumn("d", geo.great_circle(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")))
        want = [r.id for r in far.orderBy("d", "id").limit(k).collect()]
        assert got == [(i, n + 1) for n, i in enumerate(want)]


def test_a_box_prunes_tiles(spark, network):
    get, _, rows, _ = network
    stops = get().tables["stops"]
    box = cache.in_box(stops, 22.0, 23.0, 119.0, 121.0)
    assert sorted(r.id for r in box.collect()) == sorted(r[0] for r in rows if r[1] is not None and 22 <= r[1] <= 23 and 119 <= r[2] <= 121)
    plan = box._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [tile" in plan.replace("\n", " ") and "GreaterThanOrEqual(lat,22.0)" in plan
    tiles = stops.select("tile").distinct().count()
    assert box.select("tile").distinct().count() <= 6 < tiles
    code = spark.range(1).select(cache.place_code(F.lit(90.0), F.lit(180.0)).alias("a"), cache.place_code(F.lit(-90.0), F.lit(-180.0)).alias("b"), cache.place_code(F.lit(None).cast("double"), F.lit(0.0)).alias("c")).first()
    assert (code.a, code.b, code.c) == ((1 << 32) - 1, 0, None) and math.log2(code.a + 1) == 2 * cache.BITS
