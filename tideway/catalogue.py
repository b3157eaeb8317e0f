"""Registry of queries on the driver's tables, each with its SQL where SQL can express it.

Roles: `events` are position reports (user_id a vehicle, value a speed, event_type 'error' a status),
`orders` with `lineitem` are trips by the day, `customer` and `supplier` stops, `lineitem` which supplier
(stop) serves which part (route), `embeddings` points in the plane by their first two components.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators import graph, grouping, joins, ordered, sampling, segments, spatial
from .plans import metric, reach, timetable, trips

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pings(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "event_type", (F.col("event_type") == "error").alias("bad"))


_SEG = """WITH m AS (SELECT *, event_type = 'error' AS bad, lag(ts) OVER w AS pt, lag(event_type = 'error') OVER w AS pb, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN rn = 1 OR {change} epoch_us(ts) - epoch_us(pt) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM m)"""
_SEGB = _SEG.format(change="bad IS DISTINCT FROM pb OR")
DAY = 86_400


def _segmented(spark, sf_dir, indicators=("bad",)) -> DataFrame:
    return segments.segment(_pings(spark, sf_dir), "user_id", "ts", indicators, DAY, ("event_id",))


@query(_SEGB + " SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 6) AS mean_value FROM s GROUP BY user_id, segment")
def segment_runs(spark, sf_dir):
    return _segmented(spark, sf_dir).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(_SEG.format(change="") + " SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n FROM s GROUP BY user_id, segment")
def segment_by_gap(spark, sf_dir):
    return _segmented(spark, sf_dir, ()).groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(_SEGB + " SELECT user_id, CAST(segment AS BIGINT) AS segment, CASE WHEN count(*) >= 4 AND NOT bool_or(bad) THEN '+' ELSE '-' END AS quality FROM s GROUP BY user_id, segment")
def run_quality(spark, sf_dir):
    good = (F.count("*") >= 4) & ~F.bool_or("bad")
    return _segmented(spark, sf_dir).groupBy("user_id", "segment").agg(F.when(good, "+").otherwise("-").alias("quality"))


@query(_SEGB + ", r AS (SELECT user_id, segment, CASE WHEN count(*) >= 4 AND NOT bool_or(bad) THEN '+' ELSE '-' END AS q FROM s GROUP BY user_id, segment) SELECT user_id, q AS quality, count(*) AS n_runs, CAST(sum(segment) AS BIGINT) AS segments FROM r GROUP BY user_id, q")
def runs_by_quality(spark, sf_dir):
    return run_quality(spark, sf_dir).groupBy("user_id", "quality").agg(F.count("*").alias("n_runs"), F.sum("segment").alias("segments"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 OR event_type IS DISTINCT FROM p")
def dedup_consecutive(spark, sf_dir):
    return ordered.remove_repeats(_t(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "event_type").select("user_id", "event_id", "event_type")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS types, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id")
def struct_of_arrays(spark, sf_dir):
    out = grouping.struct_of_arrays(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"], collapse=False)
    return out.select("user_id", F.array_join("event_type", ",").alias("types"), F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS status FROM lineitem GROUP BY l_orderkey")
def collapse_constant(spark, sf_dir):
    out = grouping.struct_of_arrays(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])
    return out.select("l_orderkey", F.col("l_returnflag_one").alias("flag"), F.col("l_linestatus_one").alias("status"))


@query("SELECT isodow(ts) - 1 AS weekday, hour(ts) AS hour, round(count(*) * 1.0 / any_value(d), 6) AS rate FROM events JOIN (SELECT isodow(ts) AS w, count(DISTINCT CAST(ts AS DATE)) AS d FROM events GROUP BY 1) ON isodow(ts) = w GROUP BY 1, 2")
def hour_heatmap(spark, sf_dir):
    r = grouping.weekday_hour_rate(_t(spark, sf_dir, "events"), "ts")
    return r.select(F.col("weekday").cast("long").alias("weekday"), F.col("hour").cast("long").alias("hour"), F.round("rate", 6).alias("rate"))


@query("SELECT CAST(isodow(ts) - 1 AS BIGINT) AS weekday, " + ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def hour_heatmap_pivot(spark, sf_dir):
    n = _t(spark, sf_dir, "events").groupBy(F.weekday("ts").cast("long").alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return grouping.pivot_hours(n, "weekday", "n")


_PROG = """WITH tr AS (SELECT DISTINCT o_orderkey AS id, o_orderdate AS a, l_shipdate AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate),
u AS (SELECT a AS t, 1 AS n, id FROM tr UNION ALL SELECT b, -1, id FROM tr), r AS (SELECT t, n, id, CAST(sum(n) OVER (ORDER BY t, n DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM u)"""


def _trips(spark, sf_dir) -> DataFrame:
    o, line = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return o.join(line, o.o_orderkey == line.l_orderkey).where("l_shipdate > o_orderdate")


def _running(spark, sf_dir) -> DataFrame:
    tr = _trips(spark, sf_dir).select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), F.col("l_shipdate").alias("b")).distinct()
    return ordered.in_progress(tr, "a", "b", "id")


@query(_PROG + " SELECT t, n, id, running FROM r")
def running_in_progress(spark, sf_dir):
    return _running(spark, sf_dir).select("t", "n", "id", F.col("running").cast("long").alias("running"))


@query(_PROG + " SELECT CAST(t AS DATE) AS day, CAST(hour(t) AS BIGINT) AS hour, round(avg(running), 4) AS mean FROM r GROUP BY 1, 2")
def inprogress_by_day_hour(spark, sf_dir):
    return _running(spark, sf_dir).groupBy(F.to_date("t").alias("day"), F.hour("t").cast("long").alias("hour")).agg(F.round(F.avg("running"), 4).alias("mean"))


@query("SELECT bin, count(*) AS n FROM (SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 10) AS BIGINT) + 1, 10) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)) GROUP BY bin")
def distance_histogram(spark, sf_dir):
    return grouping.equal_bins(_t(spark, sf_dir, "orders"), "o_totalprice")


@query("""WITH s AS (SELECT event_type, quantile_cont(value, [0.25, 0.75]) AS q, count(value) AS m, min(value) AS lo FROM events GROUP BY event_type),
w AS (SELECT event_type, m, lo, 2 * (q[2] - q[1]) / cbrt(m) AS wd FROM s)
SELECT event_type, CAST(floor((value - lo) / wd) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (any_value(m) * any_value(wd)), 6) AS density FROM events JOIN w USING (event_type) GROUP BY 1, 2""")
def speed_fd_histogram(spark, sf_dir):
    out = grouping.freedman_diaconis(_t(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "bin", "n", F.round("density", 6).alias("density"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 1609.34, 3) AS distance_m, CAST(date_diff('day', o_orderdate, l_shipdate) AS BIGINT) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate > o_orderdate AND l_quantity >= 0.1 AND l_quantity <= 30 AND l_linenumber % 5 <> 0 AND l_suppkey % 7 <> 0""")
def trip_clean(spark, sf_dir):
    tr = _trips(spark, sf_dir)
    raw = tr.select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderdate").alias(" Trep_Pickup_Datetime "), F.col("l_shipdate").alias("Trep_Dropoff_Datetime"), F.col("l_quantity").alias("Trip_Distance"), *[F.expr(x).cast("double").alias(f"{e}_{c}") for e, x in (("Pickup", "l_linenumber % 5"), ("Dropoff", "l_suppkey % 7")) for c in ("Latitude", "Longitude")])
    return trips.clean(raw).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("distance_m", 3).alias("distance_m"), F.round(F.col("duration_s") / DAY).cast("long").alias("days"))


@query("""SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / d, 6) AS speed FROM (SELECT *, date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate)
WHERE l_quantity / d >= 0.01 AND l_quantity / d <= 1.5 AND d < 1000""")
def speed_outliers(spark, sf_dir):
    tr = _trips(spark, sf_dir).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("distance_m"), F.datediff("l_shipdate", "o_orderdate").cast("double").alias("duration_s"))
    return trips.plausible_speed(tr, 0.01, 1.5, 1000).select("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("speed_mps", 6).alias("speed"))


@query("SELECT min(o_orderdate) AS first, max(l_shipdate) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate")
def trip_span(spark, sf_dir):
    return trips.span(_trips(spark, sf_dir).select(F.col("o_orderdate").alias("ta"), F.col("l_shipdate").alias("tb")))


@query("""WITH d AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events), x AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT CAST(isodow(date) - 1 AS BIGINT) AS weekday, count(*) AS dates, count(*) * 24 AS jobs FROM x GROUP BY 1""")
def job_grid(spark, sf_dir):
    s = _t(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).first()
    return grouping.dates_by_weekday(s["a"], s["b"], spark).groupBy(F.col("weekday").cast("long").alias("weekday")).agg(F.count_distinct("date").alias("dates"), F.count("*").alias("jobs"))


@query("""WITH w AS (SELECT DISTINCT CAST(ts AS DATE) AS d, 8 AS h FROM events UNION SELECT DISTINCT CAST(ts AS DATE), 17 FROM events)
SELECT event_id FROM events JOIN w ON ts >= d + INTERVAL 1 HOUR * h AND ts < d + INTERVAL 1 HOUR * (h + 1) AND ts + INTERVAL 10 MINUTE < d + INTERVAL 1 HOUR * (h + 1)""")
def hour_window_or(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("te", F.col("ts") + F.expr("INTERVAL 10 MINUTES"))
    w = e.select(F.to_date("ts").alias("date")).distinct().select("date", F.explode(F.array(F.lit(8), F.lit(17))).alias("hour"))
    return joins.in_windows(e, "ts", "te", w).select("event_id")


@query("""SELECT c.event_id AS event_id, arg_min(v.event_id, (v.value, v.ts, v.event_id)) AS next_id FROM events c LEFT JOIN events v ON c.event_type = 'click' AND v.event_type = 'view' AND v.user_id % 10 = c.user_id % 10 AND v.ts >= c.ts AND v.ts <= c.ts + INTERVAL 60 MINUTE
WHERE c.event_type = 'click' GROUP BY c.event_id""")
def next_departure_asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("line", F.col("user_id") % 10)
    left = e.where("event_type = 'click'").select("line", "ts", "event_id")
    right = e.where("event_type = 'view'").select("line", F.col("ts").alias("eta"), "value", F.col("event_id").alias("next_id"))
    return joins.as_of_forward(left, right, ["line"], "ts", "eta", 3600, "value").select("event_id", F.col("match.next_id").alias("next_id"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS stop, l_partkey AS route, max(l_suppkey) OVER (PARTITION BY l_partkey) AS last FROM lineitem) SELECT stop, string_agg(CAST(route AS VARCHAR), ',' ORDER BY route) AS routes FROM r WHERE stop < last GROUP BY stop""")
def inverted_index(spark, sf_dir):
    rs = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("route"), F.col("l_suppkey").alias("stop"), F.col("l_suppkey").alias("seq"))
    out = joins.routes_by_stop(rs, ["route"], "stop", "seq")
    return out.select("stop", F.array_join(F.transform("routes", lambda r: r["route"].cast("string")), ",").alias("routes"))


@query("SELECT l_suppkey AS stop, l_linestatus AS direction, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS routes FROM lineitem GROUP BY 1, 2")
def stop_routes_by_direction(spark, sf_dir):
    out = joins.routes_by_stop_and_direction(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_linestatus")
    return out.select(F.col("l_suppkey").alias("stop"), F.col("l_linestatus").alias("direction"), F.array_join(F.col("routes").cast("array<string>"), ",").alias("routes"))


@query("SELECT l_linestatus AS direction, count(DISTINCT l_partkey) AS n_routes, min(l_partkey) AS first_route FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1")
def routes_through_stops(spark, sf_dir):
    stops = _t(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    out = joins.routes_through(_t(spark, sf_dir, "lineitem"), stops, "l_partkey", "l_suppkey", "l_linestatus")
    return out.select(F.col("l_linestatus").alias("direction"), F.size("routes").cast("long").alias("n_routes"), F.get("routes", 0).alias("first_route"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unknown_routes(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_and_without(c, o, ["c_custkey"])[1].select("c_custkey")


@query("SELECT o_orderkey, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM orders")
def known_route_flag(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.known_flag(o, _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey", "o_custkey", "known")


_SNAP = "(SELECT CAST(date_diff('day', (SELECT CAST(min(ts) AS DATE) FROM events), CAST(ts AS DATE)) AS BIGINT) AS k, user_id, event_type FROM events)"


def _snapshots(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    first = e.agg(F.to_date(F.min("ts"))).first()[0]
    return e.select(F.datediff(F.to_date("ts"), F.lit(first)).cast("long").alias("k"), "user_id", "event_type")


@query(f"""SELECT k, user_id, event_type FROM (SELECT a.k, a.user_id, a.event_type, unnest(range(a.n - coalesce(b.n, 0))) AS i FROM (SELECT *, count(*) AS n FROM {_SNAP} GROUP BY ALL) a
LEFT JOIN (SELECT *, count(*) AS n FROM {_SNAP} GROUP BY ALL) b ON b.k = a.k + 1 AND b.user_id = a.user_id AND b.event_type = a.event_type WHERE a.n > coalesce(b.n, 0) AND a.k < (SELECT max(k) FROM {_SNAP}))""")
def snapshot_diff(spark, sf_dir):
    return joins.snapshot_diff_all(_snapshots(spark, sf_dir), "k", ["user_id", "event_type"])


@query(f"SELECT k, user_id, event_type FROM {_SNAP} s WHERE k < (SELECT max(k) FROM {_SNAP}) AND NOT EXISTS (SELECT 1 FROM {_SNAP} t WHERE t.k = s.k + 1 AND t.user_id = s.user_id AND t.event_type = s.event_type)")
def snapshot_lost(spark, sf_dir):
    return joins.lost_rows(_snapshots(spark, sf_dir), "k", ["user_id", "event_type"])


@query("SELECT split_part(p_type, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1")
def route_prefix_counts(spark, sf_dir):
    return grouping.prefix_counts(_t(spark, sf_dir, "part"), "p_type", " ")


@query("SELECT l_partkey, n, round(n * 1.0 / (SELECT count(*) FROM lineitem), 8) AS share FROM (SELECT l_partkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1) WHERE r <= 10")
def topk_frequency_ties(spark, sf_dir):
    return grouping.frequent(_t(spark, sf_dir, "lineitem"), ["l_partkey"]).select("l_partkey", "n", F.round("share", 8).alias("share"))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def mode_first_seen(spark, sf_dir):
    return grouping.first_seen_mode(_t(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER (), 8) AS share FROM orders")
def avg_rank_pct(spark, sf_dir):
    return ordered.average_rank_global(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", F.round("share", 8).alias("share"))


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value FROM events")
def monotone_repair(spark, sf_dir):
    return ordered.running_max(_t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")), "user_id", "at", "value").select("user_id", "event_id", "value")


@query("""WITH p AS (SELECT *, lag(value) OVER w AS pv, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(value + sum(CASE WHEN pv > value THEN pv - value + 60 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 4) AS eta FROM p""")
def eta_shift_repair(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return ordered.shift_repair(e, "user_id", "at", "value").select("user_id", "event_id", F.round("value", 4).alias("eta"))


@query("SELECT user_id, event_id, round(-0.1 * (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 2) AS penalty FROM events")
def idle_penalty(spark, sf_dir):
    return ordered.idle_penalty(_t(spark, sf_dir, "events"), "user_id", "ts", -0.1).select("user_id", "event_id", F.round("penalty", 2).alias("penalty"))


@query("""SELECT user_id, round(coalesce(sum(a), 0), 2) AS integral FROM (SELECT user_id, (value + lag(value) OVER w) / 2 * ((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) GROUP BY user_id""")
def trapezoid_integral(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("x", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return ordered.trapezoid(e.withColumn("x", F.col("x") - 1_700_000_000), "user_id", "x", "value").select("user_id", F.round("integral", 2).alias("integral"))


@query("""WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM m) SELECT user_id, CAST(leg AS BIGINT) AS leg, event_type, min(ts) AS t0, max(ts) AS t1, count(*) AS n FROM s GROUP BY ALL""")
def leg_collapse(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumns({"t0": F.col("ts"), "t1": F.col("ts")})
    return ordered.collapse_legs(e, "user_id", "at", ["event_type"], "t0", "t1").select("user_id", "leg", "event_type", "t0", "t1", "n")


@query("SELECT l_suppkey, round(exp(avg(ln(l_extendedprice / l_quantity))), 4) AS factor FROM lineitem GROUP BY 1")
def geometric_mean_factor(spark, sf_dir):
    f = _t(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("f"))
    return f.groupBy("l_suppkey").agg(F.round(grouping.geometric_mean("f"), 4).alias("factor"))


@query("""WITH m AS (SELECT l_partkey AS src, l_suppkey AS dst, avg(l_quantity) AS mean FROM lineitem GROUP BY 1, 2), c AS (SELECT *, round(greatest(10, least(40, mean)), 1) AS c FROM m)
SELECT src, dst, round(mean, 6) AS mean, round((c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()), 6) AS shade FROM c""")
def minmax_normalise(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_quantity")
    return grouping.edge_means(t, "l_quantity", 10.0, 40.0).select("src", "dst", F.round("mean", 6).alias("mean"), F.round("shade", 6).alias("shade"))


_GC = "2 * 6371009 * asin(least(1, sqrt(pow(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin((radians({3}) - radians({2})) / 2), 2))))"


@query("SELECT c_custkey, round(" + _GC.format("c_acctbal / 200", "c_custkey % 80", "c_custkey % 170", "c_acctbal / 100") + ", 3) AS metres FROM customer")
def great_circle(spark, sf_dir):
    c, k = F.col("c_acctbal"), F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(geo.great_circle(c / 200, k % 170, k % 80, c / 100), 3).alias("metres"))


@query("SELECT c_custkey, round(512 * 4096 * (c_custkey % 170 + 180) / 360, 4) AS x, round(512 * 4096 / (2 * pi()) * (pi() - ln(tan(pi() / 4 + radians(c_acctbal / 200) / 2))), 4) AS y FROM customer")
def mercator_pixels(spark, sf_dir):
    p = geo.mercator_pixels(F.col("c_acctbal") / 200, F.col("c_custkey") % 170, 12)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(p["x"], 4).alias("x"), F.round(p["y"], 4).alias("y"))


@query("""WITH b AS (SELECT c_nationkey AS k, min(c_acctbal / 200) AS s, max(c_acctbal / 200) AS n, CAST(min(c_custkey % 170) AS DOUBLE) AS w, CAST(max(c_custkey % 170) AS DOUBLE) AS e FROM customer GROUP BY 1)
SELECT k, round(greatest(""" + _GC.format("s", "n", "w", "e") + ", " + _GC.format("n", "s", "w", "e") + "), 2) AS metres FROM b")
def bbox_diameter(spark, sf_dir):
    b = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min(F.col("c_acctbal") / 200).alias("s"), F.max(F.col("c_acctbal") / 200).alias("n"), F.min(F.col("c_custkey") % 170).alias("w"), F.max(F.col("c_custkey") % 170).alias("e"))
    return b.select("k", F.round(geo.bbox_diameter("w", "s", "e", "n"), 2).alias("metres"))


def _points(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_PTS = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM {_PTS} a JOIN {_PTS} b ON sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.05")
def grid_radius_join(spark, sf_dir):
    p = _points(spark, sf_dir)
    return spatial.planar_radius_join(p.withColumnRenamed("vec_id", "a_id"), p.withColumnRenamed("vec_id", "b_id"), 0.05).select("a_id", "b_id")


@query(f"SELECT vec_id AS a_id, (SELECT round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) FROM {_PTS} b WHERE b.vec_id <> a.vec_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.1) AS dist FROM {_PTS} a")
def nearest_point_distance(spark, sf_dir):
    p = _points(spark, sf_dir)
    near = spatial.planar_radius_join(p.withColumnRenamed("vec_id", "a_id"), p.withColumnRenamed("vec_id", "b_id"), 0.1)
    least = near.where("a_id <> b_id").groupBy("a_id").agg(F.round(F.min("dist"), 6).alias("dist"))
    return p.select(F.col("vec_id").alias("a_id")).join(least, "a_id", "left")


@query("""WITH d AS (SELECT q.vec_id AS query, b.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))) AS dist FROM embeddings q JOIN embeddings b ON q.vec_id % 100 = 0 AND q.vec_id <> b.vec_id)
SELECT query, id, rank FROM (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY dist, id) AS rank FROM d) WHERE rank <= 10""")
def knn_embeddings(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return spatial.k_nearest_vectors(e.where("vec_id % 100 = 0"), e, 10).select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS BIGINT) AS batch FROM events")
def batch_ids(spark, sf_dir):
    return grouping.batch_ids(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 16).select("event_id", "batch")


@query("SELECT p0, p1, p2, count(*) AS n FROM (SELECT event_type AS p0, lead(event_type) OVER w AS p1, lead(event_type, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE p2 IS NOT NULL GROUP BY ALL")
def next_point_counts(spark, sf_dir):
    paths = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("r"))
    i = F.when(F.size("r") >= 3, F.sequence(F.lit(0), F.size("r") - 3)).otherwise(F.array().cast("array<int>"))
    triples = paths.select("r", F.explode(i).alias("i"))
    at = lambda k: F.get("r", F.col("i") + k)["event_type"].alias(f"p{k}")
    return triples.groupBy(at(0), at(1), at(2)).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id), 8) AS share FROM events")
def cumulative_path(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("pos", F.struct("ts", "event_id")).withColumns({"a": F.col("ts"), "b": F.col("ts")})
    return ordered.space_time(e, "user_id", "pos", "value", "a", "b").select("user_id", "event_id", F.round("share", 8).alias("share"))


@query("SELECT times, count(*) AS edges FROM (SELECT l_partkey, l_suppkey, count(*) AS times FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def edge_coverage(spark, sf_dir):
    return grouping.coverage(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("SELECT l_returnflag, round(abs(100 * avg(log10(l_extendedprice / (l_quantity * 1000)))), 6) AS error FROM lineitem GROUP BY 1")
def error_summary(spark, sf_dir):
    h = _t(spark, sf_dir, "lineitem").withColumn("truth", F.col("l_quantity") * 1000)
    return grouping.error_summary(h, "l_returnflag", "l_extendedprice", "truth").select("l_returnflag", F.round("error", 6).alias("error"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS weekday, round(sum(greatest(0, l_extendedprice - 20000)) / 1000, 3) AS km FROM lineitem GROUP BY 1")
def column_totals(spark, sf_dir):
    m = _t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("weekday"), F.lit(0).alias("hour"), (F.col("l_extendedprice") - 20000).alias("met_m"))
    return metric.column_totals(m).select("weekday", F.round("km", 3).alias("km"))


@query("SELECT n_name, r_name, CASE WHEN n_name = r_name THEN n_name END AS same FROM nation JOIN region ON n_regionkey = r_regionkey")
def language_names(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    two = n.select("n_nationkey", F.lit("zh").alias("lang"), F.col("n_name").alias("name")).unionAll(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.lit("en"), "r_name"))
    return grouping.language_pivot(two, "n_nationkey", "lang", "name", ("zh", "en")).select(F.col("zh").alias("n_name"), F.col("en").alias("r_name"), "same")


@query("SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def consolidate_stops(spark, sf_dir):
    out = grouping.consolidate(_t(spark, sf_dir, "customer"), "c_nationkey", ["c_custkey"], firsts=["c_name"], sets=["c_mktsegment"])
    return out.select("c_nationkey", "c_name", F.array_join("c_mktsegment", ",").alias("segments"))


@query("SELECT c_mktsegment || ' / ' || c_nationkey AS name, min(c_acctbal) AS distance_m, CASE WHEN trunc(min(c_acctbal)) = trunc(max(c_acctbal)) THEN CAST(trunc(min(c_acctbal)) AS BIGINT) || 'm' ELSE CAST(trunc(min(c_acctbal)) AS BIGINT) || '~' || CAST(trunc(max(c_acctbal)) AS BIGINT) || 'm' END AS distance_text, count(DISTINCT c_custkey) AS stops FROM customer GROUP BY c_mktsegment, c_nationkey")
def stops_by_name(spark, sf_dir):
    s = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name_zh"), F.col("c_nationkey").cast("string").alias("name_en"), F.col("c_custkey").alias("stop_uid"), F.col("c_acctbal").alias("distance_m"))
    return grouping.group_stops_by_name(s).select("name", "distance_m", "distance_text", F.size("stop_uids").cast("long").alias("stops"))


@query("SELECT o_custkey AS a, lead(o_custkey) OVER w AS b, o_orderkey AS pos FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey) QUALIFY b IS NOT NULL")
def consecutive_pairs(spark, sf_dir):
    return ordered.consecutive_pairs(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", "o_custkey").select("a", "b", F.col("o_orderkey").alias("pos"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT c_custkey, 'X' FROM customer WHERE c_acctbal < 0")
def upsert_by_key(spark, sf_dir):
    target = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    source = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("o_orderkey"), F.lit("X").alias("o_orderstatus"))
    return joins.upsert(target, source, ["o_custkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_id, s AS a FROM (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id) AS n, event_type AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = n")
def last_report(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id", F.col("m.event_type").alias("a"))


# samples by hash, and searches that SQL cannot say


@query()
def hash_sample_k(spark, sf_dir):
    return sampling.random_rows(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 7)


@query()
def weighted_sample_k(spark, sf_dir):
    return sampling.weighted_subset(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", 100, 7)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem),
r(u, node) AS (SELECT src, dst FROM e WHERE src IN (SELECT dst FROM e) UNION SELECT u, e.dst FROM r JOIN e ON e.src = r.node),
c AS (SELECT a.u AS id, least(a.u, min(a.node)) AS component FROM r a JOIN r b ON b.u = a.node AND b.node = a.u GROUP BY a.u),
n AS (SELECT component, count(*) AS n FROM c GROUP BY component HAVING count(*) > 1 ORDER BY n DESC, component LIMIT 1)
SELECT id FROM c JOIN n USING (component) UNION ALL SELECT min(least(src, dst)) FROM e WHERE NOT EXISTS (SELECT * FROM n) HAVING count(*) > 0""")
def largest_component(spark, sf_dir):
    return graph.largest_component(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


def _timetable(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("string").alias("route_uid"), F.col("user_id"), F.to_date("ts").alias("d"), "ts", (F.col("event_id") * 37 % 60).alias("stop"))
    from pyspark.sql import Window as W

    w = W.partitionBy("route_uid", "d", "user_id").orderBy("ts", "stop")
    return e.select("route_uid", F.lit(0).alias("direction"), F.concat_ws("/", "user_id", "d").alias("run_id"), F.row_number().over(w).alias("seq"), "stop", F.unix_timestamp("ts").cast("double").alias("eta"))


@query()
def reach_from_stops(spark, sf_dir):
    tt = _timetable(spark, sf_dir)
    walks = spark.range(60).select(F.col("id").alias("a"), ((F.col("id") + 1) % 60).alias("b"), F.lit(600.0).alias("seconds"))
    first = tt.agg(F.min("eta")).first()[0]
    starts = spark.range(5).select(F.col("id").alias("origin"), F.lit(float(first or 0)).alias("t0"))
    return reach.earliest_arrival(starts, tt, walks)


@query()
def constant_speed_timetable(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select((F.col("s_nationkey")).cast("string").alias("route_uid"), F.lit(0).alias("direction"), F.col("s_suppkey").cast("int").alias("seq"), F.col("s_suppkey").cast("string").alias("stop_uid"), (F.col("s_acctbal") / 1e5).alias("lat"), (F.col("s_suppkey") / 1e4).alias("lon"))
    return timetable.constant_speed(s, "2018-11-05", last="08:00", spread_min=30, seed=1)
