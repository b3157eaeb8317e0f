import datetime as dt
import random

from pyspark.sql import functions as F

from tideway.operators import segments

T0 = dt.datetime(2018, 11, 5, 6)


def _rows(spark, rows):
    return spark.createDataFrame(rows, "plate string, gps_time timestamp, bad string, pos long")


def _plain(rows, gap):
    """One pass in order: (plate, time) -> segment, without later rows of one time in a segment."""
    out, seg, prev, count = [], {}, {}, {}
    for plate, t, bad, pos in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        p = prev.get(plate)
        if p is None or p[1] != bad or (t - p[0]).total_seconds() > gap:
            count[plate] = count.get(plate, 0) + 1
        prev[plate] = (t, bad)
        key = (plate, count[plate], t)
        if key not in seg:
            seg[key] = pos
            out.append((plate, count[plate], t, pos))
    return sorted(out)


def test_against_one_pass(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randint(0, 5)}", T0 + dt.timedelta(seconds=30 * rng.randint(0, 200)), rng.choice(["0", "0", "0", "1", None]), i) for i in range(400)]
    got = segments.segment(_rows(spark, rows), "plate", "gps_time", ("bad",), 300, ("pos",))
    assert sorted((r.plate, r.segment, r.gps_time, r.pos) for r in got.collect()) == _plain(rows, 300)


def test_gap_boundary_and_same_time(spark):
    m = dt.timedelta(minutes=1)
    rows = [("a", T0, "0", 0), ("a", T0, "0", 1), ("a", T0 + 5 * m, "0", 2), ("a", T0 + 10 * m + dt.timedelta(seconds=1), "0", 3), ("a", T0 + 10 * m + dt.timedelta(seconds=1), "9", 4)]
    got = sorted((r.segment, r.pos) for r in segments.segment(_rows(spark, rows), "plate", "gps_time", ("bad",), 300, ("pos",)).collect())
    assert got == [(1, 0), (1, 2), (2, 3), (3, 4)]


def _ping(i, lat, lon, status="0", plate="x"):
    return (plate, "R", 0, 20.0, 0.0, T0 + dt.timedelta(minutes=i), lat, lon, status, "0", "f", i)


def test_runs_and_quality(spark):
    from tideway import schemas

    far = [_ping(i, 22.6 + 0.01 * i, 120.3) for i in range(4)]
    short = [_ping(i, 22.6 + 0.01 * i, 120.3, plate="y") for i in range(3)]
    odd = [_ping(i, 22.6 + 0.01 * i, 120.3, status="98", plate="z") for i in range(4)]
    still = [_ping(i, 22.6, 120.3, plate="w") for i in range(5)]
    runs = {r.plate: r for r in segments.runs_from_pings(spark.createDataFrame(far + short + odd + still, schemas.PINGS)).collect()}
    assert {p: r.quality for p, r in runs.items()} == {"x": "+", "y": "-", "z": "-"}
    assert len(runs["x"].pts) == 4 and len(runs["x"].run_id) == 64
    kept = segments.within(segments.runs_from_pings(spark.createDataFrame(far, schemas.PINGS)), 120.2, 22.5, 120.4, 22.9)
    assert kept.count() == 1
    assert segments.within(segments.runs_from_pings(spark.createDataFrame(far, schemas.PINGS)), 120.2, 22.5, 120.4, 22.63).count() == 0


def test_sparsify_and_groups(spark):
    pts = [{"lat": 22.0 + 0.0001 * i, "lon": 120.0} for i in range(200)]
    df = spark.createDataFrame([(pts,)], "pts array<struct<lat:double,lon:double>>")
    kept, groups = df.select(segments.sparsified(F.col("pts"), 60), segments.waypoint_groups(F.col("pts"))).first()
    want = [0]
    for i in range(200):
        if (i - want[-1]) * 11.12 >= 60:
            want.append(i)
    assert [round((p.lat - 22) * 10000) for p in kept] == want
    assert all(4 <= len(g) <= 9 for g in groups)
    empty = spark.createDataFrame([([],)], "pts array<struct<lat:double,lon:double>>").select(segments.waypoint_groups(F.col("pts"))).first()[0]
    assert empty == []
