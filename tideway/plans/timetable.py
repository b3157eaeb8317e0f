"""Observed and constant-speed timetables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAIL_M, NEAR_STOPS, DRIFT_MPS = 50.0, 3, -0.1


def align(cost: np.ndarray) -> np.ndarray:
    """The monotone assignment of rows to columns of least total cost; ties go to the later column."""
    rows, columns = cost.shape
    best = cost[0].astype(float)
    back = np.zeros((rows, columns), np.int64)
    at = np.arange(columns)
    for r in range(1, rows):
        least = np.minimum.accumulate(best)
        # the last column at which the prefix minimum is reached
        back[r] = np.maximum.accumulate(np.where(best == least, at, 0))
        best = least + cost[r]
    out = np.zeros(rows, np.int64)
    out[-1] = columns - 1 - int(np.argmin(best[::-1]))
    for r in range(rows - 1, 0, -1):
        out[r - 1] = back[r, out[r]]
    return out


def _sphere(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (la, oa), (lb, ob) = np.radians(a).T, np.radians(b).T
    h = np.sin((lb[None] - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb)[None] * np.sin((ob[None] - oa[:, None]) / 2) ** 2
    return 2 * 6371009.0 * np.arcsin(np.minimum(1, np.sqrt(h)))


def _to_segments(stops: np.ndarray, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, relative place) of each stop to each segment between consecutive points, by the triangle's sides."""
    d = _sphere(stops, pts)
    xa, xb = d[:, :-1], d[:, 1:]
    ab = np.array([_sphere(pts[i : i + 1], pts[i + 1 : i + 2])[0, 0] for i in range(len(pts) - 1)])[None]
    safe = np.where(ab == 0, 1, ab)
    along = np.where(ab == 0, 0, (xa**2 + ab**2 - xb**2) / (2 * safe))
    height = np.sqrt(np.maximum(0, xa**2 - along**2))
    dist = np.where(along <= 0, xa, np.where(along >= ab, xb, height))
    return dist, np.clip(along / safe, 0, 1)


def stop_times(t: np.ndarray, pts: np.ndarray, stops: np.ndarray, tail_m: float = TAIL_M, near: int = NEAR_STOPS, drift: float = DRIFT_MPS) -> np.ndarray:
    """Seconds at which a run passes its stops, NaN if it comes near fewer than `near` of them.

    The cost of a stop at a segment is their distance plus a drift that makes later segments a little
    cheaper. Stops before the first and after the last near one are timed from those by the run's median
    speed where it moves.
    """
    none = np.full(len(stops), np.nan)
    if len(pts) < 2 or not len(stops):
        return none
    dist, q = _to_segments(stops, pts)
    step = np.diff(t)
    waited = np.concatenate([[0], np.cumsum(step)[:-1]])
    column = align(dist + drift * waited[None])
    row = np.arange(len(stops))
    times = t[column] + q[row, column] * step[column]
    close = dist[row, column] <= tail_m
    if close.sum() < near:
        return none
    metres = np.array([_sphere(pts[i : i + 1], pts[i + 1 : i + 2])[0, 0] for i in range(len(pts) - 1)])
    moving = (metres > 0) & (step > 0)
    if moving.any():
        speed = float(np.median(metres[moving] / step[moving]))
        first, last = np.flatnonzero(close)[[0, -1]]
        way = np.concatenate([[0], np.cumsum([_sphere(stops[i : i + 1], stops[i + 1 : i + 2])[0, 0] for i in range(len(stops) - 1)])])
        times[:first] = times[first] - (way[first] - way[:first]) / speed
        times[last + 1 :] = times[last] + (way[last + 1 :] - way[last]) / speed
    return times


def observed(runs: DataFrame, route_stops: DataFrame, scenario: str = "", **how) -> tuple[DataFrame, DataFrame]:
    """(timetable in long form, runs whose route has no stops). One group a run; the stops of its route come with it."""
    good = runs.where("quality = '+'")
    stops = route_stops.groupBy("route_uid", "direction").agg(F.array_sort(F.collect_list(F.struct("seq", "stop_uid", "lat", "lon"))).alias("stops"))
    both = good.join(stops, ["route_uid", "direction"])

    def times(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                t = np.array([p["t"].timestamp() for p in r.pts])
                found = stop_times(t, np.array([[p["lat"], p["lon"]] for p in r.pts]), np.array([[s["lat"], s["lon"]] for s in r.stops]), **how)
                rows += [(scenario, r.route_uid, r.direction, r.run_id, s["seq"], s["stop_uid"], None if np.isnan(x) else float(x)) for s, x in zip(r.stops, found, strict=True)]
            yield pd.DataFrame(rows, columns=["scenario", "route_uid", "direction", "run_id", "seq", "stop_uid", "s"])

    long = both.select("route_uid", "direction", "run_id", "pts", "stops").mapInPandas(times, "scenario string, route_uid string, direction int, run_id string, seq int, stop_uid string, s double")
    return long.select("scenario", "route_uid", "direction", "run_id", "seq", "stop_uid", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long")).alias("eta")), good.join(stops, ["route_uid", "direction"], "left_anti")


def complete_and_monotone(timetable: DataFrame) -> DataFrame:
    """Runs with a missing time go; a time before an earlier stop's is raised to it."""
    w = W.partitionBy("route_uid", "direction", "run_id")
    full = timetable.withColumn("_n", F.count(F.when(F.col("eta").isNull(), 1)).over(w)).where("_n = 0").drop("_n")
    return full.withColumn("eta", F.max("eta").over(w.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def constant_speed(route_stops: DataFrame, day: str, first: str = "06:00", last: str = "23:00", every_min: int = 15, kph: float = 17.0, spread_min: int = 30, seed: int = 0) -> DataFrame:
    """Departures from first (plus up to spread_min minutes, by a hash of the route) to last inclusive; stop times by distance along the route."""
    from ..functions import geo
    from ..operators.sampling import unit

    w = W.partitionBy("route_uid", "direction").orderBy("seq")
    step = geo.great_circle(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    at = route_stops.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("at_m", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    late = F.floor(unit(["route_uid", "direction"], seed) * spread_min).cast("int")
    starts = F.sequence(F.to_timestamp(F.lit(f"{day} {first}")) + F.make_dt_interval(mins=late), F.to_timestamp(F.lit(f"{day} {last}")), F.expr(f"INTERVAL {every_min} MINUTES"))
    eta = F.col("t0") + F.make_dt_interval(secs=(F.col("at_m") / (kph / 3.6)).cast("decimal(18,6)"))
    return at.withColumn("t0", F.explode(starts)).select("route_uid", "direction", F.date_format("t0", "HHmmss").alias("run_id"), "seq", "stop_uid", eta.alias("eta"))
