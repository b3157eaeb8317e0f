"""Streams over real files: late rows, restarts, redelivered batches; and the fixed values of the readers."""

import datetime as dt

from pyspark.sql import functions as F

from tideway.sources import readers
from tideway.streaming import live

DAY = dt.datetime(2018, 11, 5)


def at(s):
    return DAY + dt.timedelta(seconds=s)


def feed(spark, folder, batches, schema):
    """One file a batch, read one by one in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/part={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(folder))


def finish(query):
    query.processAllAvailable()
    query.stop()


def test_segments_take_late_rows_in_their_place(spark, tmp_path):
    batches = [[("b", at(0), "x"), ("b", at(200), "x")], [("b", at(100), "y"), ("b", at(300), "x"), ("b", at(250), "x")], [("b", at(900), "x"), ("c", at(10_000), "x")], [("c", at(20_000), "x")], [("c", at(20_001), "x")]]
    stream = feed(spark, tmp_path / "in", batches, "plate string, t timestamp, status string")
    out = live.segments(stream, "plate", "t", ["status"], 300, "10 minutes")
    q = out.writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "check")).start()
    finish(q)
    got = sorted((r.key, r.segment, r.start, r.end, r.n) for r in spark.table("cut").collect())
    want = [("b", 1, at(0), at(0), 1), ("b", 2, at(100), at(100), 1), ("b", 3, at(200), at(300), 3), ("b", 4, at(900), at(900), 1), ("c", 1, at(10_000), at(10_000), 1)]
    assert got == want


def test_upserts_survive_a_restart(spark, tmp_path):
    seen = []
    batch = spark.range(2)
    live.upsert_sink(lambda df, n: seen.append(n), str(tmp_path))(batch, 0)
    again = live.upsert_sink(lambda df, n: seen.append(n), str(tmp_path))  # a new driver
    again(batch, 0)
    again(batch, 1)
    assert seen == [0, 1]


def test_calendar_keeps_older_events(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(k, at(e)) for k, e in x], "id int, end_time timestamp")
    path = str(tmp_path / "calendar")
    assert live.calendar(spark, path) is None
    sink = live.calendar_sink(path, ["id"], at(100))
    sink(rows((1, 500), (2, 50)), 3)
    sink(rows((3, 600)), 4)
    live.calendar_sink(path, ["id"], at(100))(rows((9, 600)), 4)  # delivered again after a restart
    live.calendar_sink(path, ["id"], at(100), stream="other")(rows((1, 700)), 0)  # a new checkpoint
    got = sorted((r.id, r.end_time) for r in live.calendar(spark, path).collect())
    assert got == [(1, at(700)), (3, at(600))]


def test_fixed_road_classes(spark):
    kinds = ["motorway", "service", "cycleway", "footway", "elevator", "track", "living_street", "construction"]
    got = {r.highway: (r.drivable, r.cyclable, r.walkable) for r in readers.highway_classes(spark.createDataFrame([(k,) for k in kinds], "highway string")).collect()}
    yes = {"motorway": (True, None, None), "service": (True, None, None), "cycleway": (None, True, None), "footway": (None, None, True), "elevator": (None, None, True), "living_street": (True, None, True)}
    assert got == {k: yes.get(k, (None, None, None)) for k in kinds}
    tags = F.create_map(*[F.lit(x) for t in (*readers.TAGS, "surface") for x in (t, "service")])
    kept = readers.road_ways(spark.range(1).select("id", tags.alias("tags"), F.array(F.lit(1)).alias("node_ids"))).first()
    assert set(kept.tags) == {"name", "highway", "sidewalk", "private", "bus", "cycleway", "oneway", "foot", "pedestrian", "turn"}
