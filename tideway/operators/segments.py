"""Cutting streams of position reports into runs, and judging runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

GAP_S = 300
MIN_POINTS, MIN_DIAMETER_M = 4, 300.0
NORMAL = ("0",)


def segment(df: DataFrame, key: str, time: str, indicators: Sequence[str] = (), gap_s: float = GAP_S, order: Sequence[str] = (), dedup_time: bool = True) -> DataFrame:
    """df with `segment`, counted from 1 for each key in order of time.

    A new segment starts when an indicator changes (null equals null) or more than gap_s seconds pass.
    With dedup_time the later rows of one time within a segment go. One shuffle, by key; ties of time
    are broken by `order`.
    """
    w = W.partitionBy(key).orderBy(time, *order)
    prior = F.lag(time).over(w)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(prior.cast("timestamp"))
    new = F.row_number().over(w) == 1
    for c in indicators:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    new = new | (seconds > int(gap_s * 1_000_000))
    marked = df.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int"))
    out = marked.withColumn("segment", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    if dedup_time:
        same = W.partitionBy(key, "segment", time).orderBy(*(order or [F.lit(0)]))
        out = out.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return out


def runs_from_pings(pings: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """pings to runs: one row a run with its points in order; runs that never move go. run_id is a hash of plate, route, direction and first time."""
    cut = segment(pings, "plate", "gps_time", ("route_uid", "direction", "bus_status", "duty_status"), gap_s, ("src_file", "src_pos"))
    point = F.struct(F.col("gps_time").alias("t"), "lat", "lon", "speed_kph", "azimuth_deg")
    runs = cut.groupBy("plate", "segment").agg(
        F.first("route_uid").alias("route_uid"),
        F.first("direction").alias("direction"),
        F.array_sort(F.collect_list(point)).alias("pts"),
        F.first("bus_status").alias("bus_status"),
        F.first("duty_status").alias("duty_status"),
    )
    moving = runs.where(F.size(F.array_distinct(F.transform("pts", lambda p: F.struct(p["lat"], p["lon"])))) > 1)
    name = F.sha2(F.concat_ws("|", "plate", "route_uid", "direction", F.get("pts", 0)["t"].cast("string")), 256)
    return moving.select(name.alias("run_id"), "plate", "route_uid", "direction", "pts", "bus_status", "duty_status", quality(F.col("pts"), F.col("bus_status"), F.col("duty_status")).alias("quality"))


def normal(status: Column, values: Sequence[str] = NORMAL) -> Column:
    """A missing status is normal."""
    return status.isNull() | status.cast("string").isin(*values)


def all_normal(statuses: Column, values: Sequence[str] = NORMAL) -> Column:
    """Of an array of statuses."""
    return F.forall(statuses, lambda s: normal(s, values))


def quality(pts: Column, *statuses: Column) -> Column:
    """`+` for a run of enough points and extent with normal statuses, else `-`."""
    good = (F.size(pts) >= MIN_POINTS) & (geo.diameter(pts) >= MIN_DIAMETER_M)
    for s in statuses:
        good = good & normal(s)
    return F.when(good, F.lit("+")).otherwise(F.lit("-"))


def within(runs: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """Good runs all of whose points lie in the box."""
    return runs.where((F.col("quality") != "-") & F.forall("pts", lambda p: geo.in_bbox(p["lat"], p["lon"], left, bottom, right, top)))


def runs_by_quality(runs: DataFrame) -> DataFrame:
    """All runs of each flag of a route."""
    return runs.groupBy("route_uid", "direction", "quality").agg(F.sort_array(F.collect_list("run_id")).alias("run_ids"))


def sparsified(points: Column, min_m: float) -> Column:
    """Greedy: the next point at least min_m from the last one kept."""
    return F.aggregate(
        F.slice(points, 2, F.greatest(F.lit(0), F.size(points) - 1)),
        F.slice(points, 1, 1),
        lambda kept, p: F.when(geo.great_circle(F.element_at(kept, -1)["lat"], F.element_at(kept, -1)["lon"], p["lat"], p["lon"]) >= min_m, F.array_append(kept, p)).otherwise(kept),
    )


def waypoint_groups(points: Column, min_m: float = 60.0, size: int = 9, least: int = 4) -> Column:
    """Overlapping groups of at most `size` sparsified points, a third of a group apart, of at least `least` points; a group inside the one kept before goes."""
    stride = round(size / 3)
    n = F.size(points)
    starts = F.when(n >= 1, F.sequence(F.lit(1), n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    groups = F.transform(starts, lambda i: F.slice(sparsified(F.slice(points, i, F.greatest(n - i + 1, F.lit(0))), min_m), 1, size))
    groups = F.filter(groups, lambda g: F.size(g) >= least)
    return F.aggregate(
        F.slice(groups, 2, F.greatest(F.lit(0), F.size(groups) - 1)),
        F.slice(groups, 1, 1),
        lambda kept, g: F.when(F.size(F.array_except(g, F.element_at(kept, -1))) == 0, kept).otherwise(F.array_append(kept, g)),
    )
