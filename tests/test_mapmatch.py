"""Map matching by tiles, against plain searches."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.operators import graph
from tideway.plans import mapmatch

C = "run_id string, group int, wp int, src long, dst long, dist_m double, highway string"


def town(spark, side=12, step=0.002, seed=1):
    """A town of one- and two-way streets of two classes: nodes, edges and both as lists."""
    rng = random.Random(seed)
    place = {y * side + x: (22.0 + y * step + rng.uniform(0, step / 4), 120.0 + x * step + rng.uniform(0, step / 4)) for y in range(side) for x in range(side)}
    ways = []
    for n in place:
        x, y = n % side, n // side
        for m in ([n + 1] if x + 1 < side else []) + ([n + side] if y + 1 < side else []):
            kind = rng.choice(["primary", "residential", "motorway"])
            ways += [(n, m, kind), (m, n, kind)] if rng.random() < 0.8 else [(n, m, kind)]
    nodes = spark.createDataFrame([(n, *p) for n, p in place.items()], "id long, lat double, lon double")
    a, b = (nodes.select(F.col("id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    from tideway.functions import geo

    edges = spark.createDataFrame(ways, "src long, dst long, highway string").join(a, "src").join(b, "dst")
    edges = edges.select("src", "dst", "highway", (geo.great_circle("src_lat", "src_lon", "dst_lat", "dst_lon")).alias("len_m"))
    return place, nodes, spark.createDataFrame(edges.collect(), edges.schema)


def whole(edges, place):
    t = mapmatch.with_time(edges).toPandas()
    g = graph.Csr(t.src.to_numpy(), t.dst.to_numpy(), t.seconds.to_numpy())
    return g, np.array([place[i] for i in g.ids.tolist()])


def layers_of(rows, g, stubborn=mapmatch.STUBBORN):
    out = {}
    for _, _, wp, u, v, d, _ in sorted(rows, key=lambda r: (r[2], r[5], r[3], r[4])):
        out.setdefault(wp, []).append(mapmatch.Option(g.number(u), g.number(v), stubborn * 5 / 1.5 * d))
    return [out[w] for w in sorted(out)]


def plain(layers, g, pos):
    """Every choice of options with its cost, the cheapest first."""
    out = []
    for chosen in itertools.product(*map(lambda x: range(len(x)), layers)):
        o = [layer[i] for layer, i in zip(layers, chosen, strict=True)]
        seconds = lambda u, v: min(w for h, w in zip(g.head[g.begin[u] : g.begin[u + 1]], g.weight[g.begin[u] : g.begin[u + 1]], strict=True) if h == v)
        cost = o[0].cost + seconds(o[0].src, o[0].dst)
        for p, q in itertools.pairwise(o):
            cost += q.cost
            if (p.src, p.dst) != (q.src, q.dst):
                dist, pred = g.dijkstra(p.dst, {q.src})
                if q.src not in dist:
                    cost = math.inf
                    break
                way = [p.src, *g.path(pred, p.dst, q.src), q.dst]
                cost += dist[q.src] + seconds(q.src, q.dst) + sum(mapmatch._turn(pos[a], pos[b], pos[c]) for a, b, c in zip(way, way[1:], way[2:], strict=False))
        if cost < math.inf:
            out.append((cost, list(chosen)))
    return sorted(out)


def walks(edges, seed, runs, length=4, options=3):
    """Candidates of runs: random edges a few steps apart."""
    rng = random.Random(seed)
    es = sorted((r.src, r.dst, r.highway) for r in edges.collect())
    after = {}
    for u, v, h in es:
        after.setdefault(u, []).append((u, v, h))
    rows = []
    for run in range(runs):
        at = rng.choice(es)
        for wp in range(length):
            for e in {at, *rng.sample(es, 1), *rng.sample(after[at[0]], min(options - 1, len(after[at[0]])))}:
                rows.append((f"run{run}", run % 2, wp, e[0], e[1], round(rng.uniform(0, 25), 3) if e != at else 1.5, e[2]))
            for _ in range(2):
                at = rng.choice(after.get(at[1]) or [at])
    return rows


@pytest.mark.parametrize("best", [1, 5])
def test_list_viterbi_finds_the_best_choices(spark, best):
    place, _, edges = town(spark, 6)
    g, pos = whole(edges, place)
    for rows in (walks(edges, seed, 1) for seed in range(8)):
        layers = layers_of(rows, g)
        want, got = plain(layers, g, pos), mapmatch.viterbi(layers, g, pos, best)
        assert [c for c, _, _ in got] == pytest.approx([c for c, _ in want[:best]])
        costs = {tuple(s): c for c, s in want}
        assert all(costs[tuple(s)] == pytest.approx(c) for c, s, _ in got) and len({tuple(s) for _, s, _ in got}) == len(got)


@pytest.mark.parametrize("halo_m", [60.0, 300.0, 1e6])
def test_tiles_give_the_matches_of_the_whole_graph(spark, halo_m):
    place, nodes, edges = town(spark)
    g, pos = whole(edges, place)
    rows = walks(edges, 3, 10)
    c = spark.createDataFrame(rows + rows[:3] + [("run0", 0, 1, 5, 99_999, 0.0, None)], C)
    got = mapmatch.match(c.select("run_id", "group"), c, edges, nodes, best=3, halo_m=halo_m).collect()
    for run, group in {r[:2] for r in rows}:
        want = mapmatch.viterbi(layers_of([r for r in rows if r[:2] == (run, group)], g), g, pos, 3)
        mine = sorted((r for r in got if r.run_id == run), key=lambda r: r["rank"])
        assert [r.cost for r in mine] == pytest.approx([x[0] for x in want])
        assert [r.path for r in mine] == [[int(g.ids[i]) for i in x[2]] for x in want]
        assert all(len(r.active_edges) == 4 and len(r.geo_path) == len(r.path) for r in mine)
    if halo_m == 60.0:
        halos = {r.halo_m for r in got}
        assert len(halos) > 1 and max(halos) > 60.0  # some groups needed more than others


def test_the_prior_can_decide(spark):
    """Two edges at one distance: with a prior the faster class wins."""
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.001), (2, 0.001, 0.0), (3, 0.001, 0.001)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(0, 1, 111.0, "service"), (1, 3, 111.0, "service"), (3, 2, 40.0, "primary"), (2, 0, 111.0, "service")], "src long, dst long, len_m double, highway string")
    c = spark.createDataFrame([("r", 0, 0, 0, 1, 5.0, "service"), ("r", 0, 0, 3, 2, 5.0, "primary")], C)
    shares = {r.src: r.prior for r in mapmatch.prior(c).collect()}
    assert shares[3] == pytest.approx(30 / 38) and sum(shares.values()) == pytest.approx(1)
    slow = edges.withColumn("len_m", F.when(F.col("src") == 3, 500.0).otherwise(F.col("len_m")))
    for prior_s, first in ((0.0, 0), (1000.0, 3)):
        got = mapmatch.match(c.select("run_id", "group"), c, slow, nodes, prior_s=prior_s).collect()
        assert [r.active_edges[0].src for r in got] == [first]


def test_without_rows_and_off_the_graph(spark):
    place, nodes, edges = town(spark, 3)
    none = spark.createDataFrame([], C)
    assert mapmatch.match(none.select("run_id", "group"), none, edges, nodes).collect() == []
    assert mapmatch.match(none.select("run_id", "group"), none, edges.limit(0), nodes).collect() == []
    # two islands: no path joins the candidates
    two = spark.createDataFrame([(0, 1, 10.0, None), (7, 8, 10.0, None)], "src long, dst long, len_m double, highway string")
    c = spark.createDataFrame([("r", 0, 0, 0, 1, 5.0, None), ("r", 0, 1, 7, 8, 5.0, None)], C)
    assert mapmatch.match(c.select("run_id", "group"), c, two, nodes).collect() == []
    with pytest.raises(ValueError, match="without a place"):
        mapmatch.match(c.select("run_id", "group"), c, two.withColumn("dst", F.lit(10**9)), nodes)


def test_runs_share_their_piece_of_the_graph(spark, monkeypatch):
    """Ways between edges are searched once for all runs of a block, and results do not depend on how a block is dealt."""
    place, nodes, edges = town(spark, 6)
    g, pos = whole(edges, place)
    rows = walks(edges, 5, 1)
    layers, legs = layers_of(rows, g), mapmatch.Legs(g, pos)
    first = mapmatch.viterbi(layers, g, pos, 3, shared=legs)
    monkeypatch.setattr(g, "dijkstra", None)
    assert mapmatch.viterbi(layers, g, pos, 3, shared=legs) == first
    c = spark.createDataFrame([(f"{r[0]}-{i}", i, *r[2:]) for r in rows for i in range(7)], C)
    for runs in (256, 2):
        monkeypatch.setattr(mapmatch, "RUNS", runs)
        got = mapmatch.match(c.select("run_id", "group"), c, edges, nodes, best=3, halo_m=300.0).collect()
        assert {(r.run_id, r["rank"], round(r.cost, 9)) for r in got} == {(f"run0-{i}", k, round(x[0], 9)) for i in range(7) for k, x in enumerate(first, 1)}
