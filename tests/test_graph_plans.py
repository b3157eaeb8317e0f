import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway import catalogue
from tideway.operators import graph, ordered, spatial
from tideway.plans import mapmatch, metric, reach, timetable


def _dist(edges):
    """All-pairs lengths by relaxation."""
    ids = sorted({x for e in edges for x in e[:2]})
    d = {(a, b): 0.0 if a == b else math.inf for a in ids for b in ids}
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


@pytest.mark.parametrize("sent", [10**6, 0])
def test_shortest_paths(spark, sent):
    rng = random.Random(5)
    edges = [(a, b, float(rng.randint(1, 9))) for a in range(12) for b in range(12) if a != b and rng.random() < 0.2]
    want = _dist(edges)
    df = spark.createDataFrame(edges, "src long, dst long, len_m double")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12)], "u long, v long")
    got = {(r.u, r.v): (r.length, r.path) for r in graph.shortest_paths(pairs, df, sent=sent).collect()}
    weight = {(a, b): w for a, b, w in edges}
    for (a, b), w in want.items():
        assert (a, b) in got if w < math.inf else (a, b) not in got
        if w < math.inf:
            length, path = got[a, b]
            assert length == w == sum(weight[e] for e in zip(path, path[1:], strict=False)) and path[0] == a and path[-1] == b


def test_shortest_paths_off_the_graph(spark):
    edges = spark.createDataFrame([(1, 2, 0.0), (2, 1, 0.0), (2, 3, 4.0), (2, 3, 1.5), (4, 3, 1.0)], "src long, dst long, len_m double")
    pairs = spark.createDataFrame([(1, 3), (1, 3), (1, 4), (9, 1), (1, 9), (9, 9), (2, 2)], "u long, v long")
    for sent in (10**6, 0):
        got = sorted((r.u, r.v, r.path, r.length) for r in graph.shortest_paths(pairs, edges, sent=sent).collect())
        assert got == [(1, 3, [1, 2, 3], 1.5), (2, 2, [2], 0.0)]
        assert graph.shortest_paths(pairs.limit(0), edges, sent=sent).collect() == []


def test_simple_paths(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (0, 3, 1.0), (3, 1, 1.0)], "src long, dst long, len_m double")
    got = [(r.path, r.length) for r in graph.simple_paths(spark.createDataFrame([(0, 2)], "u long, v long"), edges, 5).orderBy("rank").collect()]
    assert got == [([0, 2], 5.0), ([0, 3, 1, 2], 3.0), ([0, 1, 2], 2.0)]


def _all_simple(edges, u, v):
    """All simple paths from u to v as (cost, path), by plain search."""
    ahead, out, stack = {}, [], [(0.0, [u])]
    for (a, b), w in edges.items():
        ahead.setdefault(a, []).append((b, w))
    while stack:
        g, path = stack.pop()
        if path[-1] == v:
            out.append((g, path))
            continue
        stack += [(g + w, [*path, b]) for b, w in ahead.get(path[-1], ()) if b not in path]
    return sorted(out)


@pytest.mark.parametrize("weight", [None, "cost"])
def test_simple_paths_are_the_first_of_all(spark, weight):
    rng = random.Random(8)
    edges = {(a, b): (rng.choice((1.0, 1.0, 2.0, 3.5)), float(rng.randint(1, 9))) for a in range(8) for b in range(8) if a != b and rng.random() < 0.4}
    pairs = [(0, 5), (3, 1), (6, 6), (0, 5), (7, 99), (99, 99), (None, 2), (2, 7)]
    df = spark.createDataFrame([(a, b, w, n) for (a, b), (w, n) in edges.items()] + [(4, 4, 1.0, 1.0), (0, 1, None, None), *[(a, b, 50.0, 99.0) for a, b in list(edges)[:3] if weight]], "src long, dst long, cost double, len_m double")
    if weight is None:
        df = df.where("len_m is not null")
    found = graph.simple_paths(spark.createDataFrame(pairs, "u long, v long"), df, 6, weight).collect()
    cost = {e: w if weight else 1.0 for e, (w, _) in edges.items()}
    for u, v in {p for p in pairs if None not in p}:
        want = [] if 99 in (u, v) else [p for _, p in _all_simple(cost, u, v)[:6]]
        got = sorted((r for r in found if (r.u, r.v) == (u, v)), key=lambda r: r["rank"])
        assert sorted(r.path for r in got) == sorted(want)
        length = {tuple(r.path): r.length for r in got}
        assert all(x == sum(edges[e][1] for e in zip(p, p[1:], strict=False)) for p, x in length.items())
        assert [r.length for r in got] == sorted(length.values(), reverse=True) and [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(r.hops == len(r.path) - 1 for r in got)


def test_simple_paths_cases(spark):
    edges = spark.createDataFrame([(1, 2, 1.0, 0.0)], "src long, dst long, len_m double, w double")
    pairs = spark.createDataFrame([(1, 2)], "u long, v long")
    with pytest.raises(ValueError, match="positive"):
        graph.simple_paths(pairs, edges, 2, "w")
    assert graph.simple_paths(pairs, edges.limit(0), 2).collect() == [] and graph.simple_paths(pairs.limit(0), edges, 2).collect() == []
    assert [(r.path, r["rank"]) for r in graph.simple_paths(pairs, edges, 1).collect()] == [([1, 2], 1)]


@pytest.mark.parametrize("small", [10**6, 0])
def test_largest_component(spark, small):
    rng = random.Random(2)
    edges = [(a, b) for a in range(14) for b in range(14) if a != b and rng.random() < 0.09]
    far = _dist([(a, b, 1.0) for a, b in edges])
    ids = {x for e in edges for x in e}
    groups = {frozenset(b for b in ids if far[a, b] < math.inf and far[b, a] < math.inf) for a in ids}
    got = frozenset(r.id for r in graph.largest_component(spark.createDataFrame(edges, "src long, dst long"), small).collect())
    assert got in groups and len(got) == max(map(len, groups))


def test_largest_component_ties_and_names(spark):
    """Of equal components the one with the smallest node, whatever the size; a chain has only single nodes."""
    edges = [(9, 8), (8, 9), (5, 6), (6, 5), (4, 9), (6, 8), (1, 4), (7, 7)]
    for small in (10**6, 0):
        assert sorted(r.id for r in graph.largest_component(spark.createDataFrame(edges, "src long, dst long"), small).collect()) == [5, 6]
    chain = spark.createDataFrame([(i + 1, i) for i in range(2, 8)], "src long, dst long")
    assert [r.id for r in graph.largest_component(chain).collect()] == [2] and graph.largest_component(chain.limit(0)).collect() == []


def test_largest_component_is_not_folded(spark, tmp_path):
    rows = [(1, 2), (2, 1), (501, 3), (3, 502), (1001, 1002), (1002, 1003), (1003, 1001)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert sorted(r.id for r in catalogue.QUERIES["largest_component"](spark, str(tmp_path)).collect()) == [1001, 1002, 1003]


def test_break_long_edges(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.001), (3, 0.001, 0.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 120.0), (2, 1, 120.0), (1, 3, 40.0)], "src long, dst long, len_m double")
    n, e = graph.break_long_edges(nodes, edges, 50)
    assert n.count() == 5
    rows = sorted((r.src, r.dst, r.len_m) for r in e.collect())
    assert len(rows) == 7 and {(b, a) for a, b, w in rows if w == 40.0 and {a, b} != {1, 3}} == {(a, b) for a, b, w in rows if {a, b} != {1, 3}}


def test_grid_is_strongly_connected(spark):
    nodes, edges = graph.king_grid(spark, 6, 4)
    assert graph.largest_component(edges).count() == nodes.count() == 24


def test_grid_has_one_way_rows_and_columns(spark):
    nodes, edges = graph.king_grid(spark, 4, 4, 2.0)
    place = {r.id: (r.lon / 2, r.lat / 2) for r in nodes.collect()}
    got = {(place[r.src], place[r.dst]) for r in edges.collect()}
    up = {((x, y), (x, y + 1)) if x % 2 == 0 else ((x, y + 1), (x, y)) for x in range(4) for y in range(3)}
    right = {((x, y), (x + 1, y)) if y % 2 else ((x + 1, y), (x, y)) for x in range(3) for y in range(4)}
    assert got == up | right and len(got) == 24


def test_concat_route_and_retrace(spark):
    df = spark.createDataFrame([("r", 0, [2, 1]), ("r", 1, [2, 3]), ("r", 2, [4, 3])], "route string, pos int, node_ids array<long>")
    assert graph.concat_route(df).first().node_ids == [1, 2, 3, 4]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "node long, pred long")
    assert [r.node for r in graph.retrace(tree, 3).orderBy("step").collect()] == [3, 2, 1]


def test_align_is_the_best_monotone_assignment():
    assert timetable.align(np.array([[2, 1, 1]])).tolist() == [2]
    rng = np.random.default_rng(4)
    for _ in range(60):
        m = rng.integers(0, 5, (rng.integers(1, 5), rng.integers(1, 6)))
        got = timetable.align(m)
        cost = lambda c, m=m: sum(m[r, x] for r, x in enumerate(c))
        best = min(cost(c) for c in itertools.combinations_with_replacement(range(m.shape[1]), m.shape[0]))
        assert (np.diff(got) >= 0).all() and cost(got) == best


def test_stop_times():
    lat = np.linspace(0, 0.01, 11)
    pts, t = np.stack([lat, np.zeros(11)], 1), np.arange(11) * 10.0
    stops = np.array([[0.001, 0], [0.0055, 0], [0.008, 0], [0.02, 0]])
    got = timetable.stop_times(t, pts, stops)
    assert got[:3] == pytest.approx([10, 55, 80], abs=0.2) and got[3] > 150
    assert np.isnan(timetable.stop_times(t, pts, stops[:2])).all()


def test_shift_repair(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((100, 40, 50))], "k int, i int, eta double")
    assert [r.eta for r in ordered.shift_repair(df, "k", "i", "eta").orderBy("i").collect()] == [100, 160, 170]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate((1, 3, 2, 5))], "k int, i int, eta double")
    assert [r.eta for r in ordered.running_max(df, "k", "i", "eta").orderBy("i").collect()] == [1, 3, 3, 5]


def test_spatial(spark):
    rng = random.Random(8)
    pts = [(i, 22 + rng.random() / 50, 120 + rng.random() / 50) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    a, b = df.withColumnRenamed("id", "a_id"), df.withColumnRenamed("id", "b_id")
    c = df.alias("x").crossJoin(df.alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), spatial.geo.great_circle("x.lat", "x.lon", "y.lat", "y.lon").alias("d")).collect()
    assert {(r.a_id, r.b_id) for r in spatial.radius_join(a, b, 300).collect()} == {(r.a, r.b) for r in c if r.d <= 300}
    want = {(x, r.b, k) for x in range(60) for k, r in enumerate(sorted((r for r in c if r.a == x), key=lambda r: (r.d, r.b))[:4], 1)}
    assert {(r.a_id, r.b_id, r.rank) for r in spatial.k_nearest(a, b, 4, 100.0).collect()} == want


def test_reach_against_exhaustive(spark):
    rng = random.Random(6)
    runs = [(f"r{r}", 0, f"{r}-{k}", s, (r * 3 + s * (r + 1)) % 8, 1000.0 + 300 * k + 60 * s + rng.randint(0, 30)) for r in range(4) for k in range(5) for s in range(4)]
    tt = spark.createDataFrame(runs, "route_uid string, direction int, run_id string, seq int, stop long, eta double")
    walks = [(a, (a + 1) % 8, 400.0) for a in range(8)]
    starts = spark.createDataFrame([(0, 1000.0)], "origin long, t0 double")
    got = {r.place: r.seconds for r in reach.earliest_arrival(starts, tt, spark.createDataFrame(walks, "a long, b long, seconds double"), None).collect()}
    best = {0: 1000.0}
    legs = [(a[4], b[4], a[5], b[5]) for a in runs for b in runs if a[:3] == b[:3] and b[3] == a[3] + 1]
    for _ in range(40):
        for a, b, s in walks:
            if a in best:
                best[b] = min(best.get(b, math.inf), best[a] + s)
        for a, b, t, u in legs:
            if a in best and best[a] <= t:
                best[b] = min(best.get(b, math.inf), u)
    assert got == pytest.approx({k: v - 1000 for k, v in best.items()})


def test_reach_with_a_bounded_wait_is_label_setting(spark):
    """Against a plain search that settles the earliest label first; zero walks, a place that only a missed bus leads to, two starts, a target."""
    rng = random.Random(9)
    runs = [(f"r{r}", 0, f"{r}-{k}", s, (r * 5 + s * (r + 2)) % 11, 1000.0 + 700 * k + 90 * s + rng.randint(0, 200)) for r in range(4) for k in range(4) for s in range(4)]
    walks = [(0, 5, 0.0), (5, 0, 0.0), (5, 6, 130.0), (3, 4, 250.0), (2, 2, 0.0), (9, 1, 40.0)]
    starts, wait = [(0, 1000.0), (3, 1500.0), (77, 5.0)], 300.0

    def plain(origin, t0):
        now, done = {origin: t0}, {}
        while now:
            p = min(now, key=lambda x: (now[x], x))
            t = done[p] = now.pop(p)
            ahead = [(t + s, b) for a, b, s in walks if a == p]
            for route in {(x[0], x[3]) for x in runs if x[4] == p}:
                legs = [(y[5], y[4]) for x in runs for y in runs if (x[0], x[3]) == route and x[4] == p and t <= x[5] <= t + wait and y[2] == x[2] and y[3] == x[3] + 1]
                ahead += [min(legs)] if legs else []
            for u, b in ahead:
                if b not in done:
                    now[b] = min(u, now.get(b, math.inf))
        return done

    tt = spark.createDataFrame(runs, "route_uid string, direction int, run_id string, seq int, stop long, eta double")
    w = spark.createDataFrame(walks, "a long, b long, seconds double")
    got = reach.earliest_arrival(spark.createDataFrame(starts, "origin long, t0 double"), tt, w, wait).collect()
    want = {(o, p): t - t0 for o, t0 in starts for p, t in plain(o, t0).items()}
    assert len(got) == len(want) and {(r.origin, r.place): r.seconds for r in got} == pytest.approx(want)
    assert all((r.pred is None) == (r.place == r.origin) for r in got)
    goal = max((p for o, p in want if o == 0), key=lambda p: (want[0, p], p))
    near = min((p for o, p in want if o == 0 and want[o, p] > 0), key=lambda p: (want[0, p], p))
    for target in (near, goal):
        some = reach.earliest_arrival(spark.createDataFrame(starts[:1], "origin long, t0 double"), tt, w, wait, target).collect()
        assert {r.place for r in some} == {p for o, p in want if o == 0 and want[o, p] <= want[0, target]}


def test_cgls_solves_the_damped_problem(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((7, 4)), rng.random(7)
    want = np.linalg.solve(a.T @ a + 0.01 * np.eye(4), a.T @ b)
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(7) for j in range(4)], "row int, col int, value double")
    got = metric.cgls(e, spark.createDataFrame([(i, float(b[i])) for i in range(7)], "row int, b double"), 0.1, 10)
    assert [r.x for r in got.orderBy("col").collect()] == pytest.approx(want, abs=1e-6)


def test_metric_recovery_improves(spark):
    out = dict(metric.recovery(spark, 6, 80, 0.4, 4))
    assert out[4] < out[1]


def test_map_match(spark):
    nodes, edges = graph.king_grid(spark, 4, 4, 0.001)
    edges = edges.withColumn("len_m", F.lit(111.0)).withColumn("highway", F.lit("primary"))
    cands = [("r", 0, 0, 0, 1, 1.0), ("r", 0, 1, 1, 2, 2.0), ("r", 0, 1, 2, 3, 25.0), ("r", 0, 2, 2, 3, 1.0)]
    c = spark.createDataFrame(cands, "run_id string, group int, wp int, src long, dst long, dist_m double")
    got = mapmatch.match(c.select("run_id", "group").distinct(), c, edges, nodes).collect()
    assert [r.path for r in got] == [[0, 1, 2, 3]]
    off = spark.createDataFrame([("r", 0, 0, 0, 1, 31.0)], c.schema)
    assert mapmatch.match(off.select("run_id", "group"), off, edges, nodes).count() == 0
