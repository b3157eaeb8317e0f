"""Joins that the domain needs beyond equality: as-of, windows of time, inverted indexes, consistency."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import written


def shapes_to_routes(routes: DataFrame, shapes: DataFrame) -> DataFrame:
    """routes (route_uid, ...) with `shapes`: the distinct shapes of the route in order of direction, at most two, empty if there are none."""
    listed = shapes.groupBy("route_uid").agg(F.slice(F.array_sort(F.collect_set(F.struct("direction", "geometry"))), 1, 2).alias("shapes"))
    empty = F.array().cast(listed.schema["shapes"].dataType)
    return routes.join(listed, "route_uid", "left").withColumn("shapes", F.coalesce("shapes", empty))


def routes_by_stop(route_stops: DataFrame, route: Sequence[str], stop: str, seq: str, last_too: bool = False) -> DataFrame:
    """Inverted index (stop, routes): the routes that can be boarded there, so not those that end there, unless asked for."""
    kept = route_stops
    if not last_too:
        # the end of each route by an aggregate that combines on the map side, not by a window over the route
        ends = route_stops.groupBy(*route).agg(F.max(seq).alias("_end"))
        kept = route_stops.join(ends, list(route)).where(F.col(seq) < F.col("_end"))
    return kept.groupBy(stop).agg(F.array_sort(F.collect_set(F.struct(*route))).alias("routes"))


def routes_by_stop_and_direction(route_stops: DataFrame, route: str, stop: str, direction: str) -> DataFrame:
    return route_stops.groupBy(stop, direction).agg(F.sort_array(F.collect_list(route)).alias("routes"))


def routes_through(route_stops: DataFrame, stops: DataFrame, route: str, stop: str, direction: str) -> DataFrame:
    """(direction, routes): sorted distinct routes through any of the stops."""
    return route_stops.join(stops.select(stop).distinct(), stop, "left_semi").groupBy(direction).agg(F.array_sort(F.collect_set(route)).alias("routes"))


def with_and_without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, rows of left that have no partner): the second is the list to warn about."""
    return left.join(right, list(keys)), left.join(right, list(keys), "left_anti")


def known_flag(left: DataFrame, master: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with `known`: is it in the master?"""
    return left.join(master.select(*keys).distinct().withColumn("known", F.lit(True)), list(keys), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def as_of_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], t: str, eta: str, span_s: float, best: str, out: str = "match") -> DataFrame:
    """left with `out`: of the rows of right with t <= eta <= t + span, the one with the least `best` (ties: least eta); null if none.

    Times are cut into buckets as wide as the span, so a partner is in the same bucket or the next: an
    equality join on (keys, bucket) instead of a nested loop.
    """
    span = int(span_s * 1_000_000)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    cut = lambda c: F.floor(us(c) / F.lit(span))
    names = left.columns
    row = left.withColumn("_row", F.monotonically_increasing_id())
    asked = row.select("_row", *keys, F.col(t), F.explode(F.array(cut(t), cut(t) + 1)).alias("_b"))
    have = right.withColumn("_b", cut(eta)).withColumn("_r", F.struct(*[c for c in right.columns if c not in keys]))
    met = asked.join(have.select(*keys, "_b", "_r", F.col(eta).alias("_eta"), F.col(best).alias("_best")), [*keys, "_b"])
    ok = met.where((F.col("_eta") >= F.col(t)) & (us("_eta") <= us(t) + span))
    # values of the left row travel with the key, so nothing depends on the numbering of rows
    found = ok.groupBy(*keys, t).agg(F.min(F.struct("_best", "_eta", "_r")).alias("_m")).select(*keys, t, F.col("_m._r").alias(out))
    return left.join(found, [*keys, t], "left").select(*names, out)


def in_windows(df: DataFrame, start: str, end: str, windows: DataFrame) -> DataFrame:
    """Rows whose start is in, and whose end is before the end of, one of the windows (date, hour): an hour of a date each."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = [F.to_date(start).alias("date"), F.hour(start).alias("hour")]
    tagged = df.select("*", *key).where(us(end) < us(start) - us(start) % F.lit(3_600_000_000) + 3_600_000_000)
    return tagged.join(windows.select("date", "hour").distinct(), ["date", "hour"], "left_semi").drop("date", "hour")


def lost_rows(snapshots: DataFrame, number: str, columns: Sequence[str]) -> DataFrame:
    """Rows of snapshot k that snapshot k + 1 lacks; the last snapshot has none."""
    after = snapshots.select((F.col(number) - 1).alias(number), *columns).distinct()
    last = snapshots.agg(F.max(number)).first()[0]
    return snapshots.where(F.col(number) < F.lit(last)).join(after, [number, *columns], "left_anti")


def snapshot_diff_all(snapshots: DataFrame, number: str, columns: Sequence[str]) -> DataFrame:
    """The same with multiplicities: a row that occurs n times and m times next gives n - m rows."""
    counts = snapshots.groupBy(number, *columns).agg(F.count("*").alias("_n"))
    after = counts.select((F.col(number) - 1).alias(number), *columns, F.col("_n").alias("_m"))
    last = snapshots.agg(F.max(number)).first()[0]
    c, a = counts.alias("c"), after.alias("a")
    on = F.col(f"c.{number}") == F.col(f"a.{number}")
    for x in columns:
        on = on & F.col(f"c.{x}").eqNullSafe(F.col(f"a.{x}"))
    joined = c.join(a, on, "left").select(*[F.col(f"c.{x}") for x in (number, *columns)], (F.col("_n") - F.coalesce("_m", F.lit(0))).alias("_k"))
    return joined.where((F.col("_k") > 0) & (F.col(number) < F.lit(last))).select(number, *columns, F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("_i")).drop("_i")


def pair_scores(df: DataFrame, key: str, group: str) -> DataFrame:
    """(group, a, b) of all ordered pairs i <> j within a group; groups are few rows (the caller's choice of trips to compare)."""
    a, b = df.select(group, F.col(key).alias("a")), df.select(group, F.col(key).alias("b"))
    return a.join(b, group).where(F.col("a") != F.col("b"))


#: Similarities down to which candidates are looked for, one after the other, until the best are certain.
RATIOS = (0.8, 0.6, 0.4, 0.2)


def _signs(names: DataFrame, name: str) -> DataFrame:
    """(name, n, sign): the characters of each name, each with how often it stood there before, so that common signs count what two names have in common."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    numbered = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(chars, 1, i), lambda x: x == c)).alias("i")))
    return names.select(name, F.size(chars).alias("n"), F.explode(numbered).alias("sign"))


def fuzzy_top(left: DataFrame, right: DataFrame, left_name: str, right_name: str, top: int = 6) -> DataFrame:
    """For each row of left the `top` rows of right whose names are most alike, with ratio and rank; as if all pairs had been compared.

    The ratio is twice the matching characters by all characters, and no more match than both names have in common. For a ratio r that takes a share
    r / (2 - r) of either name, so that both must share one of the rarest signs beyond that share. Candidates are joined by these signs, their lengths
    and then their common signs are bounded, and only what is left is compared; first for a high ratio, then for lower ones, and only the
    rows go on that do not have `top` names of at least that ratio. Names are compared once, however many rows bear them.

    Equal ratios stand in the order of names and then of rows. Rows without a name are like nothing. If fewer than `top` names have a character in
    common with one, the first of the others follow with ratio 0, as they would.
    """
    from ..functions.text import match_ratio

    ours = written(left.select(F.col(left_name).alias("a")).where("a is not null").distinct())
    theirs = written(right.select(F.col(right_name).alias("b")).where("b is not null").distinct())
    signs_a, signs_b = _signs(ours, "a"), _signs(theirs, "b")
    often = signs_a.select("sign").unionAll(signs_b.select("sign")).groupBy("sign").agg(F.count("*").alias("often"))
    rare = lambda s, name: written(s.join(often, "sign").withColumn("at", F.row_number().over(W.partitionBy(name).orderBy("often", "sign"))))
    signs_a, signs_b = rare(signs_a, "a"), rare(signs_b, "b")
    best, asked = W.partitionBy("a").orderBy(F.desc("ratio"), "b"), ours
    done: list[DataFrame] = []
    for r in (*RATIOS, 0.0):
        share = r / (2 - r)
        first = lambda s: s.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1)  # noqa: E731, B023
        mine = first(signs_a.join(asked, "a", "left_semi")).select("a", "sign", F.col("n").alias("na"))
        met = mine.join(first(signs_b).select("b", "sign", F.col("n").alias("nb")), "sign").where((F.col("nb") >= F.col("na") * share - 1e-9) & (F.col("na") >= F.col("nb") * share - 1e-9)).select("a", "b", "na", "nb").distinct()
        common = met.join(signs_a.select("a", "sign"), "a").join(signs_b.select("b", "sign"), ["b", "sign"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
        close = common.where(2 * F.col("common") >= r * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b", match_ratio(F.col("a"), F.col("b")).alias("ratio"))
        ranked = written(close.where((F.col("ratio") >= r) & (F.col("ratio") > 0)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
        if r == 0.0:
            done.append(ranked.select("a", "b", "ratio"))
            break
        full = ranked.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("a")
        done.append(ranked.join(full, "a", "left_semi").select("a", "b", "ratio"))
        asked = written(asked.join(full, "a", "left_anti"))
        if asked.isEmpty():
            break
    empty = ours.where("a = ''").crossJoin(F.broadcast(theirs.where("b = ''"))).withColumn("ratio", F.lit(1.0))  # one row at most: equal, without a sign
    found = reduce(DataFrame.unionAll, [*done, empty])
    # names with nothing in common: at most `top` of them are needed, and at most `top` of the first are taken by better ones
    short = ours.join(found.groupBy("a").agg(F.count("*").alias("n")), "a", "left").where(F.coalesce("n", F.lit(0)) < top).select("a")
    rest = short.crossJoin(F.broadcast(theirs.orderBy("b").limit(2 * top))).join(found.select("a", "b"), ["a", "b"], "left_anti").withColumn("ratio", F.lit(0.0))
    pairs = found.unionAll(rest.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy("b"))).where(F.col("_r") <= top).drop("_r"))
    # rows: of the best names, all that bear them, and of these the first
    rows = left.withColumn("_copy", F.row_number().over(W.partitionBy(*left.columns).orderBy(F.lit(1))))
    named = rows.join(pairs.withColumnRenamed("a", left_name), left_name).join(right.withColumn("b", F.col(right_name)), "b").drop("b")
    w = W.partitionBy(*left.columns, "_copy").orderBy(F.desc("ratio"), right_name, *[c for c in right.columns if c != right_name])
    return named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_copy")


def drop_equal_fields(df: DataFrame, master: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Fields that only repeat the master become null."""
    known = master.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(known, list(keys), "left")
    return out.withColumns({c: F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.col(c)) for c in columns}).drop(*[f"_{c}" for c in columns])


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of target with a key of source give way to source's."""
    return target.join(source.select(*keys).distinct(), list(keys), "left_anti").unionByName(source)


def expire(events: DataFrame, end: str, now, margin_s: float = 0) -> DataFrame:
    return events.where(F.col(end) >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(margin_s)).cast("decimal(18,6)")))
