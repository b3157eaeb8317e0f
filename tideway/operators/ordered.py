"""Ordered computations: windows within a key, one shuffle each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def consecutive_pairs(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, pos, a, b) of each value and the next."""
    w = W.partitionBy(key).orderBy(pos)
    return df.select(key, pos, F.col(value).alias("a"), F.lead(value).over(w).alias("b")).where("b is not null")


def pairs(array: Column) -> Column:
    """Of an array: array<struct<a, b>>."""
    n = F.greatest(F.lit(0), F.size(array) - 1)
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def remove_repeats(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """The first of each stretch of equal values (null equals null)."""
    w = W.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.lag(value).over(w).eqNullSafe(F.col(value))).where("_keep").drop("_keep")


def remove_repeats_array(array: Column) -> Column:
    return F.filter(array, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(array, i - 1)))


def running_max(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Monotone repair from left to right."""
    return df.withColumn(value, F.max(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def shift_repair(df: DataFrame, key: str, order: str, eta: str, extra: float = 60) -> DataFrame:
    """Where a time is before the one in front of it, it and all later ones move by the difference and `extra`. Neighbours share the shifts before them, so the sum of the corrections is exact."""
    w = W.partitionBy(key).orderBy(order)
    late = F.lag(eta).over(w) - F.col(eta)
    fixed = df.withColumn("_by", F.when(late > 0, late + extra).otherwise(0))
    return fixed.withColumn(eta, F.col(eta) + F.sum("_by").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_by")


def cumulative(df: DataFrame, key: str, order: Sequence[str], step: str, out: str = "at") -> DataFrame:
    """Sum of the steps up to and with each row."""
    return df.withColumn(out, F.sum(step).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def idle_penalty(df: DataFrame, key: str, time: str, rate: float, out: str = "penalty") -> DataFrame:
    """rate times the seconds since the first row, as the running sum over the gaps."""
    w = W.partitionBy(key).orderBy(time)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return df.withColumn("_g", F.coalesce(gap, F.lit(0)) / 1e6 * rate).withColumn(out, F.sum("_g").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_g")


def collapse_legs(df: DataFrame, key: str, order: str, same: Sequence[str], first: str, last: str) -> DataFrame:
    """Stretches of legs equal in `same` become one, from the first's start to the last's end."""
    w = W.partitionBy(key).orderBy(order)
    new = F.row_number().over(w) == 1
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = df.withColumn("_leg", new.cast("int"))
    island = marked.withColumn("leg", F.sum("_leg").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(key, "leg", *same).agg(F.min_by(first, order).alias(first), F.max_by(last, order).alias(last), F.count("*").alias("n"))


def trapezoid(df: DataFrame, key: str, t: str, f: str) -> DataFrame:
    """(key, integral) of f over t."""
    w = W.partitionBy(key).orderBy(t)
    area = (F.col(f) + F.lag(f).over(w)) / 2 * (F.col(t) - F.lag(t).over(w))
    return df.select(key, area.alias("_a")).groupBy(key).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


def in_progress(df: DataFrame, start: str, end: str, id_: str, bucket: str | None = None) -> DataFrame:
    """(t, n, id, running): +1 at each start and -1 at each end, and how many are under way; starts come before ends of the same time.

    A running sum over all rows needs one order. It is taken in two levels: sums within days, which are
    dealt over tasks, on top of the totals of the days before, which are few.
    """
    both = df.select(F.col(start).alias("t"), F.lit(1).alias("n"), F.col(id_).alias("id")).unionAll(df.select(F.col(end), F.lit(-1), F.col(id_)))
    dated = both.withColumn("day", F.to_date("t"))
    totals = dated.groupBy("day").agg(F.sum("n").alias("net"))
    before = totals.withColumn("before", F.coalesce(F.sum("net").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("day", "before")
    w = W.partitionBy("day").orderBy("t", F.desc("n"), "id").rowsBetween(W.unboundedPreceding, 0)
    return dated.withColumn("_r", F.sum("n").over(w)).join(before, "day").select("t", "n", "id", (F.col("_r") + F.col("before")).alias("running"))


def average_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank share with ties averaged: (rank + (ties - 1) / 2) / n. Of a key, if given; else over all rows, so only for small frames."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over((W.partitionBy(*by, value))) - 1) / 2.0) / F.count("*").over(w)


def average_rank_global(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """The same over all rows, from counts of distinct values: what is ordered is one row a value, summed in two levels by ranges of values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.repartitionByRange(parts, value).withColumn("part", F.spark_partition_id())
    from ..frames import checkpointed

    ranged = checkpointed(ranged)
    totals = ranged.groupBy("part").agg(F.sum("ties").alias("all"))
    before = totals.withColumn("before", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = totals.agg(F.sum("all")).first()[0] or 1
    w = W.partitionBy("part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranks = ranged.withColumn("_in", F.coalesce(F.sum("ties").over(w), F.lit(0))).join(before, "part").select(value, ((F.col("before") + F.col("_in") + 1 + (F.col("ties") - 1) / 2.0) / n).alias(out))
    return df.join(ranks, value, "left")


def space_time(df: DataFrame, key: str, pos: str, step: str, start: str, end: str) -> DataFrame:
    """Along each path the time at which it gets there, if the way from start to end is spread by the steps' metric."""
    w = W.partitionBy(key).orderBy(pos)
    share = F.try_divide(F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)), F.sum(step).over(W.partitionBy(key)))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return df.withColumn("share", share).withColumn("at", F.timestamp_micros((us(start) + F.round((us(end) - us(start)) * F.col("share"))).cast("long")))


def merge_interpolate(a: DataFrame, b: DataFrame, key: str, t: str, columns: Sequence[str], method: str = "time") -> DataFrame:
    """Full outer merge of two series on (key, t); gaps are interpolated linearly (by time, or by row), the tail carries the last value on, rows still incomplete go."""
    left = a.select(key, t, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(key, t, *[F.col(c).alias(f"{c}_b") for c in columns])
    both = left.join(right, [key, t], "full")
    w = W.partitionBy(key).orderBy(t)
    x = F.unix_micros(F.col(t).cast("timestamp")).cast("double") if method == "time" else F.row_number().over(w).cast("double")
    out = both.withColumn("_x", x)
    for c in [f"{c}_{s}" for s in "ab" for c in columns]:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col("_x").alias("x"), F.col(c).alias("v")))
        prior = F.last(seen, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
        later = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
        out = out.withColumn("_p", prior).withColumn("_l", later)
        between = F.col("_p.v") + (F.col("_l.v") - F.col("_p.v")) * F.try_divide(F.col("_x") - F.col("_p.x"), F.col("_l.x") - F.col("_p.x"))
        out = out.withColumn(f"{c}_f", F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("_l").isNull(), F.col("_p.v")).otherwise(between)).drop("_p", "_l")
    full = [f"{c}_{s}_f" for s in "ab" for c in columns]
    return out.dropna(subset=full).select(key, t, *[F.col(c).alias(c[:-2]) for c in full])
