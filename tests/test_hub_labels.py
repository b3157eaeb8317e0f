"""Distances and paths by hub labels, against all-pairs relaxation."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tideway.operators import hub_labels


def all_pairs(edges):
    ids = sorted({x for e in edges for x in e[:2]})
    d = {(a, b): 0.0 if a == b else math.inf for a in ids for b in ids}
    for a, b, w in edges:
        d[a, b] = min(d[a, b], w)
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def sparse(seed, n, p):
    rng = random.Random(seed)
    return [(a, b, float(rng.randint(0, 9))) for a in range(n) for b in range(n) if a != b and rng.random() < p]


def grid(side, seed):
    rng = random.Random(seed)
    return [(*e, float(rng.randint(1, 20))) for n in range(side * side) for m in ([n + 1] if n % side < side - 1 else []) + ([n + side] if n < side * side - side else []) for e in ((n, m), (m, n)) if rng.random() < 0.9]


@pytest.mark.parametrize(("edges", "cell"), [(sparse(1, 14, 0.15), 2), (grid(7, 2), 3), (sparse(3, 10, 0.3), 512)])
def test_distances_and_paths(spark, edges, cell):
    want, weight = all_pairs(edges), {}
    for a, b, w in edges:
        weight[a, b] = min(w, weight.get((a, b), math.inf))
    df = spark.createDataFrame(edges + [(3, 3, 1.0), (edges[0][0], edges[0][1], 99.0), (None, 1, 1.0), (500, 500, 1.0)], "src long, dst long, len_m double").withColumn("mid", F.lit("clash"))
    rng = random.Random(8)
    nodes = spark.createDataFrame([(i, rng.uniform(-3, 3) if i % 7 else float(i), float(i % 7)) for i in range(60) if i != 5] + [(4, 0.0, 0.0)], "id long, lat double, lon double")
    found = hub_labels.build(df, nodes, cell=cell)
    assert (found.rounds > 1) == (cell < 512)
    ids = sorted({x for e in edges for x in e[:2]})
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids] + [(500, 500), (500, 1), (1, 1), (999, 1), (None, 1)], "u long, v long")
    got = {(r.u, r.v): (r.length, r.path) for r in hub_labels.paths(pairs, found).collect()}
    assert {(r.u, r.v): r.length for r in hub_labels.distances(pairs, found).collect()} == {k: x[0] for k, x in got.items()}
    assert got.pop((500, 500)) == (0.0, [500])
    assert {k: x[0] for k, x in got.items()} == {k: w for k, w in want.items() if w < math.inf}
    for (a, b), (length, path) in got.items():
        assert path[0] == a and path[-1] == b and sum(weight[e] for e in itertools.pairwise(path)) == length


def test_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, len_m double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    found = hub_labels.build(none, nodes)
    pairs = spark.createDataFrame([(1, 2)], "u long, v long")
    assert hub_labels.distances(pairs, found).collect() == [] and hub_labels.paths(pairs, found).collect() == []
    with pytest.raises(ValueError, match="negative"):
        hub_labels.build(spark.createDataFrame([(1, 2, -1.0)], none.schema), nodes)
