"""Distances and trees by sweeps over nested cells, against all-pairs relaxation, and on a long street."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_hub_labels import all_pairs, grid, sparse

from tideway.operators import graph, hub_labels, sweeps
from tideway.plans import trips


@pytest.mark.parametrize(("edges", "cell"), [(sparse(1, 14, 0.15), 2), (grid(7, 2), 3), (sparse(3, 10, 0.3), 512)])
def test_distances(spark, edges, cell, monkeypatch):
    want = all_pairs(edges)
    df = spark.createDataFrame(edges + [(3, 3, 1.0), (edges[0][0], edges[0][1], 99.0), (None, 1, 1.0), (2, 1, None), (500, 500, 1.0)], "src long, dst long, len_m double")
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, rng.uniform(-3, 3) if i % 7 else float(i), float(i % 7)) for i in range(60) if i != 5] + [(4, 0.0, 0.0)], "id long, lat double, lon double")
    ids = sorted({x for e in edges for x in e[:2]})
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if (a + b) % 3] * 2 + [(500, 500), (500, 1), (999, 1), (None, 1), (1, None)], "u long, v long")
    monkeypatch.setattr(sweeps, "SOURCES", 5)
    got = {(r.u, r.v): r.length for r in sweeps.distances(pairs, df, nodes, cell=cell).collect()}
    assert got.pop((500, 500)) == 0.0
    assert got == {k: w for k, w in want.items() if w < math.inf and sum(k) % 3}


def test_trees(spark):
    """Every path back along the tree has the distance of its edges."""
    edges = grid(7, 4) + [(100, 101, 2.0)]
    want, weight = all_pairs(edges), {}
    for a, b, w in edges:
        weight[a, b] = w
    df = spark.createDataFrame(edges, "src long, dst long, len_m double")
    nodes = spark.createDataFrame([(i, i // 7 * 1.0, i % 7 * 1.0) for i in range(49)], "id long, lat double, lon double")
    us = [0, 3, 24, 48, 100, 999]
    found = sweeps.trees(spark.createDataFrame([(u,) for u in us + us], "u long"), df, nodes, cell=4)
    tree = {(r.u, r.node): (r.pred, r.dist) for r in found.collect()}
    assert {k: d for k, (_, d) in tree.items()} == {(u, v): w for (u, v), w in want.items() if u in us and w < math.inf}
    for (u, v), (_, dist) in tree.items():
        length = 0.0
        while v != u:
            length, v = length + weight[tree[u, v][0], v], tree[u, v][0]
        assert length == dist and tree[u, u] == (None, 0.0)
    known = spark.createDataFrame([(1, 0, 48), (2, 0, 100), (3, 3, 3), (4, 100, 101)], "trip_id long, u long, v long")
    lines = {r.trip_id: (tuple(r.first), tuple(r.last), r.trajectories) for r in trips.tree_trajectories(known, found, nodes).collect()}
    assert lines == {1: ((0.0, 0.0), (6.0, 6.0), 2), 3: ((0.0, 3.0), (0.0, 3.0), 2)}
    with pytest.raises(ValueError, match="positive"):
        sweeps.trees(found.select("u"), df.withColumn("len_m", F.lit(0.0)), nodes)


def test_needed_arcs_give_all_distances():
    """Arcs that two shorter ones replace go, zero ones among them stay."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = 9
        s, t, w = rng.integers(0, n, 30), rng.integers(0, n, 30), rng.integers(0, 4, 30).astype(float)
        d = sweeps._closed(n, s, t, w)
        a, b = np.nonzero(sweeps._needed(d))
        assert (sweeps._closed(n, a, b, d[a, b]) == d).all() and len(a) < np.isfinite(d).sum() - n
        known = np.where(rng.random((3, n)) < 0.3, rng.integers(0, 9, (3, n)).astype(float), np.inf)
        assert (sweeps._spread(known, s, t, w) == sweeps._spread(known, s, t, w, d)).all()


def test_cells_of_a_long_street_are_not_strips(spark):
    """4 x 4,096 places: a cell of 64 along the curve has few neighbours outside, whichever way the network is longer."""
    nodes = spark.range(4 * 4096).select("id", (F.floor(F.col("id") / 4) / 1000).alias("lat"), (F.col("id") % 4 / 1000).alias("lon"))
    placed = sorted((r.code, r.id) for r in hub_labels.curve(nodes).collect())
    cell = {i: k // 64 for k, (_, i) in enumerate(placed)}
    across = sum(cell[i] != cell[j] for i in cell for j in ([i + 4] if i + 4 in cell else []) + ([i + 1] if i % 4 < 3 else []))
    assert across < 0.07 * len(cell)


@pytest.mark.parametrize("sent", [0, 1000])
def test_loads_of_trees_are_those_of_the_paths(spark, sent):
    """Sums over edges without taking paths apart, against paths taken apart; both ways."""
    edges = [(a, b, w + random.Random(a * 50 + b).random()) for a, b, w in grid(6, 3)] + [(100, 101, 2.0)]  # no equal paths
    df = spark.createDataFrame(edges, "src long, dst long, len_m double")
    rng = random.Random(2)
    rows = [(rng.choice([0, 7, 20]), rng.randrange(36), rng.randrange(1, 5), rng.uniform(1, 9)) for _ in range(60)]
    loads = spark.createDataFrame(rows + [(100, 101, 1, 0.5), (0, 100, 1, 1.0), (999, 0, 1, 1.0), (0, 999, 1, 1.0), (None, 1, 1, 1.0), (7, 7, 1, 1.0)], "u long, v long, n long, s double")
    paths = {(r.u, r.v): (r.path, r.length) for r in graph.shortest_paths(loads.select("u", "v"), df).collect()}
    want = {}
    for u, v, n, s in [*rows, (100, 101, 1, 0.5)]:
        path, length = paths.get((u, v), ([], 0.0))
        for e in itertools.pairwise(path):
            a, b = want.get(e, (0, 0.0))
            want[e] = a + n, b + s - n * math.log(length)
    got = {(r.src, r.dst): (r.n, r.s) for r in graph.tree_loads(loads, df, sent=sent).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e]) for e in want)
