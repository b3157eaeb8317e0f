import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tideway.functions import geo, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def P(lat, lon):
    return F.struct(F.lit(float(lat)).alias("lat"), F.lit(float(lon)).alias("lon"))


def test_distances(spark):
    a, b, c = one(spark, geo.great_circle(0.0, 0.0, 0.0, 1.0), geo.haversine(0.0, 0.0, 0.0, 1.0), geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert a == pytest.approx(math.radians(1) * 6371009) and b == pytest.approx(math.radians(1) * 6367500)
    assert c == pytest.approx(111319.4908, abs=1e-3)
    x, y = one(spark, geo.geodesic(F.lit(50.0), F.lit(5.0), F.lit(-7.0), F.lit(100.0)), geo.geodesic(F.lit(-7.0), F.lit(100.0), F.lit(50.0), F.lit(5.0)))
    assert x == pytest.approx(y, rel=1e-12)


def test_turns(spark):
    straight, back, left = one(spark, geo.turn_angle(P(0, 0), P(1, 0), P(2, 0)), geo.turn_angle(P(0, 0), P(1, 0), P(0, 0)), geo.turn_angle(P(0, 0), P(0.001, 0), P(0.001, -0.001)))
    assert straight == pytest.approx(0) and back == -180 and left == pytest.approx(-90, abs=0.01)


def test_segment_distance(spark):
    before, after, zero, beside = one(spark, geo.segment_distance(P(-1, 0), P(0, 0), P(1, 0)), geo.segment_distance(P(2, 0), P(0, 0), P(1, 0)), geo.segment_distance(P(0, 1), P(0, 0), P(0, 0)), geo.segment_distance(P(0.0005, 0.001), P(0, 0), P(0.001, 0)))
    degree = math.radians(1) * 6371009
    assert before.t == 0 and before.dist_m == pytest.approx(degree)
    assert after.t == 1 and after.dist_m == pytest.approx(degree)
    assert zero.t == 0 and zero.dist_m == pytest.approx(degree)
    assert beside.t == pytest.approx(0.5) and beside.dist_m == pytest.approx(degree / 1000, rel=1e-4)


def test_polygon_boundary_is_outside(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    at = lambda lat, lon: geo.in_polygon(F.lit(lat), F.lit(lon), [ring, hole])
    assert tuple(one(spark, at(3.0, 3.0), at(1.5, 1.5), at(0.0, 2.0), at(4.0, 4.0), at(5.0, 1.0), at(1.0, 1.5))) == (True, False, False, False, False, False)
    assert geo.longest_ring_polygon([[[(0, 0), (1, 0), (1, 1)]], [ring]]) == [ring]


def test_refine_and_lengths(spark):
    pts = F.array(P(0, 0), P(0, 0.0002))
    fine, length = one(spark, geo.refine(pts, 5.0), geo.path_length(geo.refine(pts, 5.0)))
    assert len(fine) == 9 and length == pytest.approx(0.0002 * math.radians(1) * 6371009)
    assert len(one(spark, geo.refine(F.array(P(1, 1)), 5.0))[0]) == 1


def test_mercator_round_trip(spark):
    p = geo.mercator_pixels(22.6, 120.3, 12)
    back = one(spark, geo.pixels_to_degrees(p["x"], p["y"], 12))[0]
    assert back.lat == pytest.approx(22.6) and back.lon == pytest.approx(120.3)
    assert one(spark, geo.covering_zoom(120.0, 22.0, 120.1, 22.1))[0] == 12
    assert one(spark, geo.snap_dyadic(F.lit(1.3), F.lit(0.0), F.lit(8.0)))[0] == 2.0


def test_planar_fit(spark):
    rng = random.Random(1)
    pairs = [(22 + rng.random() / 10, 120 + rng.random() / 10, 22 + rng.random() / 10, 120 + rng.random() / 10) for _ in range(33)]
    a, b = geo.fit_planar(pairs)
    assert a == pytest.approx(110_700, rel=0.01) and b == pytest.approx(103_000, rel=0.02)
    with pytest.raises(ValueError):
        geo.fit_planar([(-60 + 3 * i, 0, 60 - i, 170) for i in range(20)])


def test_text(spark):
    line, brackets, ratio, names = one(spark, text.parse_linestring(F.lit("LINESTRING(120.1 22.5, 120.2 22.6)")), text.strip_brackets(F.lit("Main (east)")), text.match_ratio(F.lit("abcd"), F.lit("bcde")), text.unformat("{a}/x.{b}", F.lit("p/q/x.y")))
    assert [(p.lat, p.lon) for p in line] == [(22.5, 120.1), (22.6, 120.2)] and brackets == "Main" and ratio == 0.75 and (names.a, names.b) == ("p/q", "y")
    now = F.lit(dt.datetime(2018, 11, 5, 21, 0)).cast("timestamp")
    got = one(spark, *[text.arrival_time(F.lit(x), now) for x in ("21:32", "4分鐘", "soon", "00:10")], text.eta_clock(F.lit(-1), now), text.eta_clock(F.lit(60), now))
    assert tuple(got) == (dt.datetime(2018, 11, 5, 21, 32), dt.datetime(2018, 11, 5, 21, 4), None, dt.datetime(2018, 11, 6, 0, 10), "?", "21:01")


def test_envelope(spark):
    value = {"a": [1, 2, {"b": "é"}]}
    packed = text.json_zip(value)
    assert list(packed) == [text.ENVELOPE] and text.json_unzip(packed) == value
    assert text.json_unzip(value, insist=False) == value
    for bad in (value, [1], "x", {text.ENVELOPE: "!!"}):
        with pytest.raises(RuntimeError):
            text.json_unzip(bad, insist=True)
    import json

    got = one(spark, text.unzip_json_text(F.lit(json.dumps(packed))), text.unzip_json_text(F.lit("{broken")))
    assert json.loads(got[0]) == value and got[1] is None
