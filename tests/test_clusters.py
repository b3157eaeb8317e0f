"""Complete linkage, against merging one nearest pair after the other."""

import random

from tideway.plans import consensus, network


def plain(d, n):
    """[(distance, lo, hi)] of all merges in order."""
    groups, out = [[i] for i in range(n)], []
    while len(groups) > 1:
        far, i, j = min((max(d[min(x, y), max(x, y)] for x in groups[i] for y in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        out.append((far, *sorted((min(groups[i]), min(groups[j])))))
        groups[i] += groups.pop(j)
    return out


def test_linkage(spark):
    rng = random.Random(4)
    sets = {k: {(i, j): rng.random() for i in range(n) for j in range(i + 1, n)} for k, n in (("a", 12), ("b", 5), ("c", 2))}
    rows = [(k, i, j, x) for k, d in sets.items() for (i, j), x in d.items()]
    got = consensus.linkage(spark.createDataFrame(rows, "route string, a int, b int, dist double"), "route").collect()
    for k, n in (("a", 12), ("b", 5), ("c", 2)):
        assert sorted((r.dist, r.lo, r.hi) for r in got if r.route == k) == plain(sets[k], n)
    assert max(r["round"] for r in got) < 10


def test_main_cluster(spark):
    """Eight sources make two clusters at a quarter: the larger family stays."""
    rng = random.Random(1)
    one, two = list(range(60)), list(range(100, 160))
    vary = lambda x: [v for v in x if rng.random() < 0.9]
    rows = [("r", i, vary(one if i in (0, 2, 3, 5, 6) else two)) for i in range(8)]
    rows += [("s", i, vary(two if i < 6 else one)) for i in range(8)] + [("one", 0, [1, 2]), (None, 0, [1]), ("r", 99, None)]
    got = consensus.main_cluster(spark.createDataFrame(rows, "route string, run int, path array<long>"), "route").collect()
    assert sorted((r.route, r.run) for r in got) == [("one", 0), *(("r", i) for i in (0, 2, 3, 5, 6)), *(("s", i) for i in range(6))]
    assert consensus.main_cluster(spark.createDataFrame([], "route string, run int, path array<long>"), "route").collect() == []


def test_stop_and_route_rules(spark):
    stops = [(1, 22.0, {"public_transport": "platform", "bus": "yes", "name": "A"}), (2, None, {}), (3, 22.0, None)]
    got = network.violations(spark.createDataFrame(stops, "id long, lat double, tags map<string,string>"), network.STOP_RULES).collect()
    assert sorted((r.id, r.rule) for r in got) == [(2, "no_name"), (2, "node_missing"), (2, "not_bus"), (2, "not_platform"), (3, "no_name"), (3, "not_bus"), (3, "not_platform")]
    good = {"type": "route", "route": "bus", "ref": "1", "name": "R", "public_transport:version": "2"}
    routes = [(1, good), (2, good | {"roundtrip": "maybe", "public_transport:version": "1"}), (3, {"roundtrip": "yes"})]
    got = network.violations(spark.createDataFrame(routes, "id long, tags map<string,string>"), network.ROUTE_RULES).collect()
    assert sorted((r.id, r.rule) for r in got) == [(2, "bad_roundtrip"), (2, "old_scheme"), (3, "no_name"), (3, "no_ref"), (3, "not_bus"), (3, "not_route"), (3, "old_scheme")]
