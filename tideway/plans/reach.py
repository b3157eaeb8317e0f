"""Earliest arrival over walks and scheduled runs, and what can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import written
from ..operators import spatial

WALK_MPS, STOP_RADIUS_M, MAX_WAIT_S = 1.0, 50.0, 3600.0


def walk_legs(places: DataFrame, radius_m: float = STOP_RADIUS_M, mps: float = WALK_MPS) -> DataFrame:
    """places (id, lat, lon) to (a, b, seconds) between places within the radius, each to itself too."""
    a = places.select(F.col("id").alias("a_id"), "lat", "lon")
    return spatial.radius_join(a, places.select(F.col("id").alias("b_id"), "lat", "lon"), radius_m).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (F.col("dist_m") / mps).alias("seconds"))


def graph_walk_legs(edges: DataFrame, loose: DataFrame, nodes: DataFrame, k: int = 10, mps: float = WALK_MPS) -> DataFrame:
    """Legs along the edges of a graph, both ways; places off the graph (id, lat, lon) reach their k nearest nodes."""
    along = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("len_m") / mps).alias("seconds"))
    back = along.select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds")
    off = spatial.k_nearest(loose.select(F.col("id").alias("a_id"), "lat", "lon"), nodes.select(F.col("id").alias("b_id"), "lat", "lon"), k)
    on = off.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (F.col("dist_m") / mps).alias("seconds"))
    return along.unionAll(back).unionAll(on).unionAll(on.select(F.col("b").alias("a"), F.col("a").alias("b"), "seconds")).groupBy("a", "b").agg(F.min("seconds").alias("seconds"))


def _scheduled(timetable: DataFrame) -> DataFrame:
    """(route, a, dep, arr, b, what): each run's legs from one stop to the next. A loop route may visit a stop twice: `route` names its place in the run, too."""
    w = W.partitionBy("route_uid", "direction", "run_id").orderBy("seq")
    legs = timetable.select("route_uid", "direction", "run_id", "seq", F.col("stop").alias("a"), F.col("eta").alias("dep"), F.lead("stop").over(w).alias("b"), F.lead("eta").over(w).alias("arr"))
    return legs.where("b is not null").select(F.struct("route_uid", "direction", "seq").alias("route"), "a", "dep", "arr", "b", F.concat_ws("/", "route_uid", "direction", "run_id").alias("what"))


def _onward(labels: DataFrame, legs: DataFrame, walks: DataFrame, max_wait_s: float | None) -> DataFrame:
    """labels to those one leg on: (origin, t0, place, t, pred, mode, what). Of a route's departures within the wait the one that arrives first is taken."""
    here = labels.select("origin", "t0", F.col("place").alias("a"), "t")
    afoot = here.join(walks.where("a <> b"), "a").select("origin", "t0", F.col("b").alias("place"), (F.col("t") + F.col("seconds")).alias("t"), F.col("a").alias("pred"), F.lit("walk").alias("mode"), F.lit("").alias("what"))
    if max_wait_s is None:
        caught = here.join(legs, "a").where("dep >= t")
    else:  # a departure within the wait is of the label's stretch of time or of the next
        width = F.lit(max(float(max_wait_s), 1.0))
        slot = F.floor(F.col("t") / width)
        near = here.withColumn("slot", F.explode(F.array(slot, slot + 1)))
        caught = near.join(legs.withColumn("slot", F.floor(F.col("dep") / width)), ["a", "slot"]).where((F.col("dep") >= F.col("t")) & (F.col("dep") <= F.col("t") + F.lit(float(max_wait_s))))
    first = caught.groupBy("origin", "t0", "a", "route").agg(F.min(F.struct("arr", "dep", "b", "what")).alias("l"))
    return afoot.unionAll(first.select("origin", "t0", F.col("l.b").alias("place"), F.col("l.arr").alias("t"), F.col("a").alias("pred"), F.lit("bus").alias("mode"), "l.what"))


def earliest_arrival(starts: DataFrame, timetable: DataFrame, walks: DataFrame, max_wait_s: float | None = MAX_WAIT_S, target=None) -> DataFrame:
    """starts (origin, t0 in epoch seconds) to (origin, t0, place, seconds, pred, mode, what): one label a place, the earliest arrival.

    timetable: (route_uid, direction, run_id, seq, stop, eta in epoch seconds) with stops and walk ends
    named alike (long). With a bound on the wait, arriving earlier may miss what a later arrival catches,
    as bounded waiting is; with None the result is exact. With a target, labels later than its own are left out.

    Labels are settled in rounds of joins, all starts at once. No label yet to come is earlier than what
    the open labels of a start lead to by their next leg: those up to that time are final, and only
    from final ones the search goes on. Ties go to the smaller predecessor.
    """
    key = ["origin", "t0"]
    walks = written(walks.groupBy("a", "b").agg(F.min(F.col("seconds").cast("double")).alias("seconds")))
    legs = written(_scheduled(timetable))
    blank = [F.lit(None).cast(kind).alias(name) for kind, name in (("long", "pred"), ("string", "mode"), ("string", "what"))]
    begin = starts.select(F.col("origin").cast("long").alias("origin"), F.col("t0").cast("double").alias("t0")).distinct()
    fresh = written(begin.select("origin", "t0", F.col("origin").alias("place"), F.col("t0").alias("t"), *blank))
    settled, parts = fresh.limit(0), 0
    while not fresh.isEmpty():
        ahead = written(_onward(fresh, legs, walks, max_wait_s))
        least = ahead.groupBy(*key).agg(F.min("t").alias("least"))
        judged = written(fresh.join(least, key, "left").withColumn("final", F.col("least").isNull() | (F.col("t") <= F.col("least"))).drop("least"))
        done = judged.where("final").drop("final")
        settled, parts = settled.unionAll(done), parts + 1
        if parts % 8 == 0:
            settled = written(settled)
        told = ahead.join(done.select(*key, F.col("place").alias("pred")), [*key, "pred"], "left_semi").select(fresh.columns)
        waiting = judged.where("not final").select(fresh.columns).unionAll(told).join(settled.select(*key, "place"), [*key, "place"], "left_anti")
        if target is not None:
            waiting = waiting.join(done.where(F.col("place") == F.lit(target)).select(*key), key, "left_anti")
        fresh = written(waiting.groupBy(*key, "place").agg(F.min(F.struct("t", "pred", "mode", "what")).alias("m")).select(*key, "place", "m.*"))
    if target is not None:
        end = settled.where(F.col("place") == F.lit(target)).select(*key, F.col("t").alias("end"))
        settled = settled.join(end, key, "left").where("end is null or t <= end")
    return settled.select(*key, "place", (F.col("t") - F.col("t0")).alias("seconds"), "pred", "mode", "what")


def sweep(origins: DataFrame, first: str, last: str, every_min: int = 1) -> DataFrame:
    """(origin, t0): each origin at each start minute, both ends included."""
    times = F.sequence(F.to_timestamp(F.lit(first)), F.to_timestamp(F.lit(last)), F.expr(f"INTERVAL {every_min} MINUTES"))
    return origins.select("origin", F.explode(times).alias("t")).select("origin", F.unix_timestamp("t").cast("double").alias("t0"))


def fastest(reach: DataFrame, places: DataFrame) -> DataFrame:
    """(lat, lon, minutes): least travel time to each location."""
    return reach.join(places.select(F.col("id").alias("place"), "lat", "lon"), "place").groupBy("lat", "lon").agg((F.min("seconds") / 60).alias("minutes"))


def tree_difference(a: DataFrame, b: DataFrame, most: int = 4) -> DataFrame:
    """Places whose (seconds, pred) differ between two results, the earliest first."""
    x, y = (d.select("place", F.col("seconds").alias(f"s{i}"), F.col("pred").alias(f"p{i}")) for i, d in enumerate((a, b)))
    both = x.join(y, "place", "full").where(~(F.col("s0").eqNullSafe(F.col("s1")) & F.col("p0").eqNullSafe(F.col("p1"))))
    return both.orderBy(F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0)), "place").limit(most)
