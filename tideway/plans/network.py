"""Stop and route networks, arrivals, data quality, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import arrival_time, destination, eta_clock, match_ratio
from ..operators import grouping, joins, spatial


def assemble(stops: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """stops (route_uid, direction, seq as text, sid, name_zh, name_en, lat, lon) to the network's long table: in order, without the skipped route directions; one sid in two places raises."""
    kept = stops if skip is None else stops.join(skip, ["route_uid", "direction"], "left_anti")
    kept = kept.withColumn("seq", F.col("seq").try_cast("int"))
    clash = kept.groupBy("sid").agg(F.count_distinct("name_zh", "lat", "lon").alias("n")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"stop {clash[0][0]} has conflicting entries")
    return kept


def route_names(routes: DataFrame) -> DataFrame:
    """routes (id, lang, name) to one row an id with both languages, and `same` where they agree."""
    return grouping.language_pivot(routes, "id", "lang", "name", ("zh", "en"))


def nearest_stops(positions: DataFrame, stops: DataFrame, k: int = 20) -> DataFrame:
    """positions (a_id, lat, lon) to their k nearest stops, grouped by name with least distance."""
    near = spatial.k_nearest(positions, stops.select(F.col("stop_uid").alias("b_id"), "lat", "lon"), k)
    named = near.join(stops.select(F.col("stop_uid").alias("b_id"), "name_zh", "name_en"), "b_id")
    low, high = F.min("dist_m").cast("int"), F.max("dist_m").cast("int")
    return named.groupBy("a_id", F.concat_ws(" / ", "name_zh", "name_en").alias("name")).agg(F.min("dist_m").alias("distance_m"), F.when(low == high, F.format_string("%dm", low)).otherwise(F.format_string("%d~%dm", low, high)).alias("distance_text"), F.array_sort(F.collect_set("b_id")).alias("stop_uids")).orderBy("a_id", "distance_m", "name")


def departures(arrivals: DataFrame, now, lang: str | None = None) -> DataFrame:
    """arrivals (stop_name, route, direction, dept, dest, time_text) in order of time; texts that are no time come last."""
    at = arrival_time(F.col("time_text"), F.lit(now).cast("timestamp"))
    to = F.trim(F.when(F.col("direction") == 1, F.col("dest")).otherwise(F.col("dept"))) if lang is None else destination(F.col("direction"), F.col("dept"), F.col("dest"), lang)
    out = arrivals.withColumn("eta", at).withColumn("destination", to)
    return out.orderBy(F.col("eta").isNull(), "eta", "time_text", "route", "destination")


def arrivals_nearby(positions: DataFrame, stops: DataFrame, arrivals: DataFrame, now, k: int = 20) -> DataFrame:
    """Stops near a position with the arrivals at their names, nearest first."""
    return nearest_stops(positions, stops, k).withColumn("stop_name", F.split("name", " / ")[0]).join(departures(arrivals, now), "stop_name").orderBy("a_id", "distance_m", F.col("eta").isNull(), "eta")


def eta_texts(etas: DataFrame, now) -> DataFrame:
    return etas.withColumn("clock", eta_clock(F.col("eta_s"), F.lit(now).cast("timestamp")))


def search(table: DataFrame, text: str, name: str, top: int = 25) -> DataFrame:
    """The `top` rows whose name is most like a text."""
    return table.withColumn("ratio", match_ratio(F.col(name), F.lit(text))).orderBy(F.desc("ratio"), name).limit(top)


def match_routes(ours: DataFrame, theirs: DataFrame, top: int = 6) -> DataFrame:
    """ours and theirs (name, first_stop, last_stop; theirs with prefix t_) to the pairs of most alike names, with the mean likeness of their end stops."""
    best = joins.fuzzy_top(ours, theirs, "name", "t_name", top)
    return best.withColumn("ends", (match_ratio("first_stop", "t_first_stop") + match_ratio("last_stop", "t_last_stop")) / 2)


STOP_RULES = {
    "node_missing": "lat IS NULL",
    "not_platform": "coalesce(tags['public_transport'], '') <> 'platform'",
    "not_bus": "coalesce(tags['bus'], '') <> 'yes'",
    "no_name": "coalesce(tags['name'], '') = ''",
}
ROUTE_RULES = {
    "not_route": "coalesce(tags['type'], '') <> 'route'",
    "not_bus": "coalesce(tags['route'], '') <> 'bus'",
    "no_ref": "coalesce(tags['ref'], '') = ''",
    "bad_roundtrip": "coalesce(tags['roundtrip'], 'no') NOT IN ('yes', 'no')",
    "old_scheme": "coalesce(tags['public_transport:version'], '') <> '2'",
    "no_name": "coalesce(tags['name'], '') = ''",
}


def violations(df: DataFrame, rules: dict[str, str], key: str = "id") -> DataFrame:
    """(key, rule) of each broken rule."""
    broken = F.filter(F.array(*[F.when(F.expr(e), F.lit(r)) for r, e in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def timetable_search_views(timetable: DataFrame, route_stops: DataFrame) -> dict[str, DataFrame]:
    """What a search for journeys reads: timetable of complete runs, stops with places, routes by stop."""
    from .timetable import complete_and_monotone

    return {
        "timetable": complete_and_monotone(timetable),
        "stops": route_stops.groupBy("stop_uid").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")),
        "routes_by_stop": joins.routes_by_stop(route_stops, ["route_uid", "direction"], "stop_uid", "seq"),
    }
