"""Grouping and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _field(name: str):
    return lambda x: x[name]


def struct_of_arrays(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], collapse: bool = True, never: Sequence[str] = (), as_list: Sequence[str] = ()) -> DataFrame:
    """One row a key; each column becomes its values in order, and `<column>_one`, set if all are equal (null equals null).

    Columns in `never` do not collapse; those in `as_list` collapse to a list of one. Typed columns
    instead of a variant: the array is null where the single value stands for it.
    """
    packed = df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in columns]))).alias("r"))
    out = [*map(F.col, key)]
    for c in columns:
        values = F.transform("r", _field(f"v_{c}"))
        same = F.size(F.array_distinct(values)) == 1
        if c in never or not collapse:
            out.append(values.alias(c))
        elif c in as_list:
            out.append(F.when(same, F.slice(values, 1, 1)).otherwise(values).alias(c))
        else:
            out += [F.when(~same, values).alias(c), F.when(same, F.get(values, 0)).alias(f"{c}_one")]
    return packed.select(*out)


def language_pivot(df: DataFrame, key: str, lang: str, value: str, languages: Sequence[str]) -> DataFrame:
    """(key, one column a language, `same`: the value if all languages agree)."""
    wide = df.groupBy(key).pivot(lang, list(languages)).agg(F.first(value))
    equal = F.size(F.array_distinct(F.array(*languages))) == 1
    return wide.withColumn("same", F.when(equal, F.col(languages[0])))


def first_seen_mode(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """The most frequent value; of ties the one seen first."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*key).agg(F.max_by(F.struct(value, "n"), F.struct("n", F.negate(F.col("_first")))).alias("m")).select(*key, f"m.{value}", "m.n")


def consolidate(df: DataFrame, key: str, order: Sequence[str], firsts: Sequence[str] = (), sets: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """One row a key: first values, sorted distinct values, last values."""
    at = F.struct(*order)
    aggs = [F.min_by(c, at).alias(c) for c in firsts] + [F.array_sort(F.collect_set(c)).alias(c) for c in sets] + [F.max_by(c, at).alias(c) for c in lasts]
    return df.groupBy(key).agg(*aggs)


def group_stops_by_name(stops: DataFrame) -> DataFrame:
    """stops (name_zh, name_en, stop_uid, distance_m) by `zh / en`: distance_m (least), distance_text (`a~bm`, or `am`), stop_uids."""
    name = F.concat_ws(" / ", "name_zh", "name_en")
    low, high = F.min("distance_m").cast("int"), F.max("distance_m").cast("int")
    return stops.groupBy(name.alias("name")).agg(
        F.min("distance_m").alias("distance_m"),
        F.when(low == high, F.format_string("%dm", low)).otherwise(F.format_string("%d~%dm", low, high)).alias("distance_text"),
        F.array_sort(F.collect_set("stop_uid")).alias("stop_uids"),
    )


def weekday_hour_rate(df: DataFrame, time: str) -> DataFrame:
    """(weekday, hour, rate): rows divided by the number of dates of that weekday; Monday is 0."""
    cut = df.select(F.weekday(time).alias("weekday"), F.hour(time).alias("hour"), F.to_date(time).alias("d"))
    days = cut.groupBy("weekday").agg(F.count_distinct("d").alias("days"))
    return cut.groupBy("weekday", "hour").agg(F.count("*").alias("n")).join(F.broadcast(days), "weekday").select("weekday", "hour", (F.col("n") / F.col("days")).alias("rate"))  # seven rows


def pivot_hours(df: DataFrame, rows: str, value: str) -> DataFrame:
    """Columns h0 to h23, absent ones 0."""
    wide = df.groupBy(rows).pivot("hour", list(range(24))).agg(F.first(value)).na.fill(0)
    return wide.select(rows, *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def equal_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin from 1, n): equal widths between least and greatest; the greatest is in the last bin."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.select(F.lit(1).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    if low == high:
        return df.where(F.col(value).isNotNull()).groupBy(F.lit(1).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def freedman_diaconis(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bin from 0, n, density): bins of twice the quartile range by the cube root of n."""
    stats = df.groupBy(key).agg(F.percentile(value, [0.25, 0.75]).alias("q"), F.count(value).alias("all"), F.min(value).alias("low"))
    width = stats.select(key, "all", "low", (2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt(F.col("all").cast("double"))).alias("width"))
    placed = df.where(F.col(value).isNotNull()).join(width, key).withColumn("bin", F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("low"), F.col("width"))), F.lit(0).cast("long")))
    return placed.groupBy(key, "bin").agg(F.count("*").alias("n"), F.first("all").alias("all"), F.first("width").alias("width")).select(key, "bin", "n", F.try_divide(F.col("n"), F.col("all") * F.col("width")).alias("density"))


def dates_by_weekday(first, last, spark) -> DataFrame:
    """(weekday, date, hour) over a span of dates."""
    days = spark.sql("SELECT 1").select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 DAY"))).alias("date"))
    return days.select(F.weekday("date").alias("weekday"), "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def prefix_counts(df: DataFrame, value: str, sep: str = "_") -> DataFrame:
    """(prefix, n) of the part before the separator, most frequent first."""
    return df.groupBy(F.split(value, f"\\Q{sep}\\E")[0].alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix")


def edge_means(traversals: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """(src, dst, mean, shade): mean of a value for each edge, clipped, rounded and scaled to 0..1."""
    means = traversals.groupBy("src", "dst").agg(F.avg(value).alias("mean"))
    clipped = means.withColumn("_c", F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("mean"))), 1))
    span = clipped.agg(F.min("_c").alias("a"), F.max("_c").alias("b")).first()
    a, b = span["a"], span["b"]
    scale = F.lit(0.0) if a is None or a == b else (F.col("_c") - a) / (b - a)
    return clipped.select("src", "dst", "mean", scale.alias("shade"))


def geometric_mean(value: str) -> Column:
    """Null where no value is positive."""
    return F.exp(F.avg(F.when(F.col(value) > 0, F.ln(value))))


def coverage(traversals: DataFrame) -> DataFrame:
    """(times, edges): how many edges were crossed so often."""
    return traversals.groupBy("src", "dst").agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("edges"))


def error_summary(history: DataFrame, key: str, estimate: str, truth: str) -> DataFrame:
    """(key, error): |100 * mean(log10(estimate / truth))|."""
    return history.groupBy(key).agg(F.abs(100 * F.avg(F.log10(F.try_divide(estimate, truth)))).alias("error"))


def frequent(df: DataFrame, value: Sequence[str], rank: int = 10) -> DataFrame:
    """(value, n, share) of values at least as frequent as the rank-th; ties stay."""
    counts = df.groupBy(*value).agg(F.count("*").alias("n"))
    # the cut is found on the distinct counts, of which there are few, so no task orders all values
    cut = counts.groupBy("n").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < rank).agg(F.min("n")).first()[0]
    total = df.count()
    return counts.where(F.col("n") >= (cut or 0)).withColumn("share", F.col("n") / F.lit(max(1, total)))


def all_distinct(column: str) -> Column:
    return F.count(column) == F.count_distinct(column)


def all_same(column: str) -> Column:
    return F.count_distinct(column) == 1


def batch_ids(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Batches of a fixed size within each key, counted from 0."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1) / size))


def catalogue(files: DataFrame, path: str, need: Sequence[str]) -> DataFrame:
    """Files pivoted by extension: (stem, one column an extension); stems that lack one go."""
    cut = files.select(F.regexp_extract(path, r"^(.*)\.([^./]+)$", 1).alias("stem"), F.regexp_extract(path, r"^(.*)\.([^./]+)$", 2).alias("ext"), F.col(path).alias("p"))
    return cut.groupBy("stem").pivot("ext", list(need)).agg(F.first("p")).dropna()


def boxes(points: DataFrame, id_: str, most: int = 5, depth: int = 24) -> DataFrame:
    """points (id, lat, lon) with `box`: a string of halvings of the bounding box, each box split across its longer side until it holds at most so many points."""
    b = points.agg(F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    now = points.select(id_, "lat", "lon", F.lit("").alias("box"), *[F.lit(v).cast("double").alias(n) for v, n in zip(b, ("x0", "x1", "y0", "y1"), strict=True)])
    from ..frames import checkpointed

    done = None
    for _ in range(depth):
        sizes = now.groupBy("box").agg(F.count("*").alias("n"))
        both = checkpointed(now.join(sizes, "box"))
        part = both.where(F.col("n") <= most).select(id_, "lat", "lon", "box")
        done = part if done is None else done.unionAll(part)
        wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
        mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
        up = F.when(wide, F.col("lon") > mx).otherwise(F.col("lat") > my)
        rest = both.where(F.col("n") > most)
        now = rest.select(id_, "lat", "lon", F.concat("box", F.when(up, "1").otherwise("0")).alias("box"), F.when(wide & up, mx).otherwise(F.col("x0")).alias("x0"), F.when(wide & ~up, mx).otherwise(F.col("x1")).alias("x1"), F.when(~wide & up, my).otherwise(F.col("y0")).alias("y0"), F.when(~wide & ~up, my).otherwise(F.col("y1")).alias("y1"))
        if now.isEmpty():
            return done
    return done.unionAll(now.select(id_, "lat", "lon", "box"))


def busiest_first(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """(*keys, source, n, place): the distinct sources of each group, with their number and the group's place, from the group of most sources; ties by the keys. Null sources do not count."""
    from .graph import numbered

    known = df.where(F.col(source).isNotNull()).select(*keys, source).distinct()
    groups = known.groupBy(*keys).agg(F.count("*").alias("n")).withColumns({"_less": -F.col("n"), "_one": F.lit(1)})
    placed = numbered(groups, ["_less", *keys], "_one", "_ahead").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", (F.col("_ahead") + 1).cast("long").alias("place"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return known.join(placed, on).select(*keys, source, "n", "place")
