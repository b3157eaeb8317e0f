"""Geometry as column expressions: no UDF but for the ellipsoid.

Three earth models are kept apart by name: the sphere of mean radius (`great_circle`), the WGS-84
ellipsoid (`geodesic`) and the haversine with the radius of the nearest-node index (`haversine`).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import vectorised

SPHERE_M = 6371009.0
INDEX_SPHERE_M = 6367500.0
MILE_M = 1609.34


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2, radius_m: float = INDEX_SPHERE_M) -> Column:
    a1, o1, a2, o2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return F.lit(2 * radius_m) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def great_circle(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the mean sphere."""
    return haversine(lat1, lon1, lat2, lon2, SPHERE_M)


def vincenty(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Metres on the WGS-84 ellipsoid, by the inverse formula; nearly antipodal pairs that do not converge are NaN."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    span = np.radians(np.asarray(lon2) - np.asarray(lon1))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = span
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
            cs = su1 * su2 + cu1 * cu2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * sl / np.where(ss == 0, 1, ss))
            c2a = 1 - sa**2
            c2m = np.where(c2a == 0, 0, cs - 2 * su1 * su2 / np.where(c2a == 0, 1, c2a))
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = span + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (-1 + 2 * c2m**2)))
            moved = np.nanmax(np.abs(new - lam), initial=0)
            lam = new
            if moved < 1e-12:
                break
        k = c2a * (a * a - b * b) / (b * b)
        big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        d = small * ss * (c2m + small / 4 * (cs * (-1 + 2 * c2m**2) - small / 6 * c2m * (-3 + 4 * ss**2) * (-3 + 4 * c2m**2)))
        return np.where(ss == 0, 0.0, b * big * (sigma - d))


@vectorised("double")
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres on the ellipsoid (Arrow batches; no built-in expression iterates)."""
    return pd.Series(vincenty(*(x.to_numpy(float) for x in (lat1, lon1, lat2, lon2))))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Degrees clockwise from north."""
    a1, o1, a2, o2 = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.degrees(F.atan2(y, x))


def turn_angle(p: Column, q: Column, r: Column) -> Column:
    """Signed turn in degrees, [-180, 180), of the way p, q, r (structs of lat, lon); a reversal is -180."""
    d = bearing(q["lat"], q["lon"], r["lat"], r["lon"]) - bearing(p["lat"], p["lon"], q["lat"], q["lon"])
    # bearings of a straight reversal differ by 180 only up to rounding
    turned = F.pmod(d + 540, F.lit(360.0)) - 180
    return F.when(F.abs(F.abs(turned) - 180) < 1e-6, F.lit(-180.0)).otherwise(turned)


def segment_distance(x: Column, a: Column, b: Column, distance=great_circle) -> Column:
    """struct<dist_m, t>: from point x to segment ab, and the relative place of the nearest point, by the triangle's sides; t is 0 or 1 beyond the ends."""
    d = lambda p, q: distance(p["lat"], p["lon"], q["lat"], q["lon"])
    xa, xb, ab = d(x, a), d(x, b), d(a, b)
    along = F.try_divide(xa * xa + ab * ab - xb * xb, 2 * ab)
    height = F.sqrt(F.greatest(F.lit(0.0), xa * xa - along * along))
    return (
        F.when(ab == 0, F.struct(xa.alias("dist_m"), F.lit(0.0).alias("t")))
        .when(along <= 0, F.struct(xa.alias("dist_m"), F.lit(0.0).alias("t")))
        .when(along >= ab, F.struct(xb.alias("dist_m"), F.lit(1.0).alias("t")))
        .otherwise(F.struct(height.alias("dist_m"), F.try_divide(along, ab).alias("t")))
    )


def path_length(points: Column, distance=great_circle) -> Column:
    """Sum of the steps of an array of points; 0 for fewer than two."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.lit(0), F.size(points) - 1)), F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)), lambda p, q: distance(p["lat"], p["lon"], q["lat"], q["lon"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def total_turn(points: Column) -> Column:
    """Sum of absolute turns along an array of points, in degrees."""
    n = F.size(points)
    middle = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(middle, F.lit(0.0), lambda s, i: s + F.abs(turn_angle(F.get(points, i - 1), F.get(points, i), F.get(points, i + 1))))


def bbox(points: Column) -> Column:
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(F.array_min(lon).alias("left"), F.array_min(lat).alias("bottom"), F.array_max(lon).alias("right"), F.array_max(lat).alias("top"))


def bbox_diameter(left, bottom, right, top) -> Column:
    """The longer diagonal of a box, in metres."""
    return F.greatest(great_circle(bottom, left, top, right), great_circle(top, left, bottom, right))


def diameter(points: Column) -> Column:
    b = bbox(points)
    return bbox_diameter(b["left"], b["bottom"], b["right"], b["top"])


def padded(low, high, share: float = 0.01) -> Column:
    """struct<low, high>, wider by a share of the extent on each side."""
    low, high = _col(low), _col(high)
    return F.struct((low - (high - low) * share).alias("low"), (high + (high - low) * share).alias("high"))


def nice_axis(left, right, bottom, top, expand: float = 1.1, aspect: float = (1 + math.sqrt(5)) / 2) -> Column:
    """struct<left, right, bottom, top> around the same centre, expanded, with neither side shorter than the other over `aspect`."""
    left, right, bottom, top = map(_col, (left, right, bottom, top))
    cx, cy, w, h = (left + right) / 2, (bottom + top) / 2, (right - left) * expand, (top - bottom) * expand
    w2, h2 = F.greatest(w, h / aspect), F.greatest(h, w / aspect)
    return F.struct((cx - w2 / 2).alias("left"), (cx + w2 / 2).alias("right"), (cy - h2 / 2).alias("bottom"), (cy + h2 / 2).alias("top"))


def mercator_pixels(lat, lon, zoom) -> Column:
    """struct<x, y>: pixels of the web map whose world is 512 * 2**zoom wide."""
    world = F.lit(512.0) * F.pow(F.lit(2.0), _col(zoom))
    y = F.ln(F.tan(F.lit(math.pi / 4) + F.radians(_col(lat)) / 2))
    return F.struct((world * (_col(lon) + 180) / 360).alias("x"), (world / (2 * math.pi) * (F.lit(math.pi) - y)).alias("y"))


def pixels_to_degrees(x, y, zoom) -> Column:
    world = F.lit(512.0) * F.pow(F.lit(2.0), _col(zoom))
    lat = F.degrees(2 * F.atan(F.exp(F.lit(math.pi) - _col(y) * (2 * math.pi) / world)) - math.pi / 2)
    return F.struct(lat.alias("lat"), (_col(x) / world * 360 - 180).alias("lon"))


def covering_zoom(left, bottom, right, top, window: int = 1024) -> Column:
    """The largest zoom from 16 down to 1 at which the box fits a square window of pixels; 1 if none."""

    def fits(z: Column) -> Column:
        p, q = mercator_pixels(bottom, left, z), mercator_pixels(top, right, z)
        return (F.abs(q["x"] - p["x"]) <= window) & (F.abs(p["y"] - q["y"]) <= window)

    return F.coalesce(F.get(F.filter(F.sequence(F.lit(16), F.lit(1), F.lit(-1)), fits), 0), F.lit(1))


def snap_dyadic(x, a, b) -> Column:
    """x on the grid whose step is the power of two at or below a quarter of |b - a|."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(_col(b) - _col(a)) / 4)))
    return F.coalesce(F.round(F.try_divide(_col(x), step)) * step, _col(x))


def refine(points: Column, max_len_m: float = 5.0) -> Column:
    """Midpoints are put in until no step is longer: each step gets a power of two of equal parts."""
    n = F.size(points)

    def parts(i: Column) -> Column:
        p, q = F.get(points, i), F.get(points, i + 1)
        k = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.greatest(F.lit(1e-9), great_circle(p["lat"], p["lon"], q["lat"], q["lon"]) / max_len_m))).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((p["lat"] + (q["lat"] - p["lat"]) * j / k).alias("lat"), (p["lon"] + (q["lon"] - p["lon"]) * j / k).alias("lon")))

    inner = F.flatten(F.transform(F.when(n >= 2, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), parts))
    last = F.transform(F.slice(points, F.greatest(F.lit(1), n), 1), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return F.concat(inner, last)


def in_bbox(lat, lon, left: float, bottom: float, right: float, top: float) -> Column:
    """Strictly inside."""
    return (_col(lon) > left) & (_col(lon) < right) & (_col(lat) > bottom) & (_col(lat) < top)


def longest_ring_polygon(polygons: list[list[list[tuple[float, float]]]]) -> list[list[tuple[float, float]]]:
    """Of polygons (outer ring and holes, points (lon, lat)) the one of the greatest perimeter."""

    def perimeter(rings):
        return sum(math.dist(p, q) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))

    return max(polygons, key=perimeter)


def in_polygon(lat, lon, rings: list[list[tuple[float, float]]]) -> Column:
    """Strictly inside by even-odd ray casting over all rings (lon, lat); the boundary is outside. The box test comes first and reaches the scan."""
    lat, lon = _col(lat), _col(lon)
    edges = [(*p, *q) for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]], strict=True) if p != q]
    xs, ys = [e[0] for e in edges], [e[1] for e in edges]
    known = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in edges])

    def crosses(e: Column) -> Column:
        at = e["x1"] + (lat - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])
        return ((e["y1"] > lat) != (e["y2"] > lat)) & F.coalesce(lon < at, F.lit(False))

    def on(e: Column) -> Column:
        flat = (e["x2"] - e["x1"]) * (lat - e["y1"]) == (e["y2"] - e["y1"]) * (lon - e["x1"])
        return flat & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.size(F.filter(known, crosses)) % 2 == 1
    return in_bbox(lat, lon, min(xs), min(ys), max(xs), max(ys)) & odd & ~F.exists(known, on)


def fit_planar(pairs: list[tuple[float, float, float, float]]) -> tuple[float, float]:
    """(a, b) of sqrt(a^2 dlat^2 + b^2 dlon^2), least squares against the ellipsoid over (lat1, lon1, lat2, lon2); over 1 % off raises."""
    p = np.array(pairs, float)
    x, y = (p[:, 2] - p[:, 0]) ** 2, (p[:, 3] - p[:, 1]) ** 2
    d = vincenty(*p.T) ** 2
    a2, b2 = np.linalg.lstsq(np.stack([x, y], 1), d, rcond=None)[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        off = np.abs(np.sqrt(a2 * x + b2 * y) / np.sqrt(d) - 1)
    if np.nanmax(off) > 0.01:
        raise ValueError("the area is too large for a planar metric")
    return math.sqrt(a2), math.sqrt(b2)


def planar(lat1, lon1, lat2, lon2, a: float, b: float) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    return F.sqrt(F.pow((lat2 - lat1) * a, 2) + F.pow((lon2 - lon1) * b, 2))
