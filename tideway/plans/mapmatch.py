"""Map matching: a run's waypoints to the path of edges that costs least.

The objective is stubborn * 5 * miss / 1.5 seconds for each waypoint (metres missed) plus travel time
plus turn penalties. The choice of edges is found exactly over the candidates, by dynamic programming
along the waypoints, so a run gives the same path every time. The graph is dealt to tiles, and a group of waypoints
gets the tiles that its cheapest path provably stays in.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import scratch, written
from ..functions import geo
from ..operators import spatial
from ..operators.graph import Csr

#: km/h by road class.
CLASS_KPH = {
    "motorway": 50, "trunk": 40, "primary": 30, "secondary": 20, "tertiary": 18, "unclassified": 16, "residential": 12, "service": 8,
    "motorway_link": 30, "trunk_link": 20, "primary_link": 15, "secondary_link": 10, "tertiary_link": 9,
}
OTHER_KPH = 8
MAX_MISS_M, STUBBORN, VERSION = 30.0, 0.2, "viterbi-2"
#: Groups of a block that a task takes at once.
RUNS = 256


def with_time(edges: DataFrame) -> DataFrame:
    """edges with seconds: length by the speed of the class."""
    speed = F.coalesce(F.create_map(*[F.lit(x) for kv in CLASS_KPH.items() for x in kv])[F.col("highway")], F.lit(OTHER_KPH))
    return edges.withColumn("seconds", F.col("len_m") / (speed / 3.6))


def _turn(p, q, r) -> float:
    def bearing(a, b):
        a1, o1, a2, o2 = map(math.radians, (*a, *b))
        return math.degrees(math.atan2(math.sin(o2 - o1) * math.cos(a2), math.cos(a1) * math.sin(a2) - math.sin(a1) * math.cos(a2) * math.cos(o2 - o1)))

    a = abs((bearing(q, r) - bearing(p, q) + 540) % 360 - 180)
    return 120.0 if a >= 150 else 30 * a / 90 if a >= 30 else 0.0


def prior(candidates: DataFrame) -> DataFrame:
    """candidates (run_id, group, wp, highway, dist_m) with `prior`: an edge's share in its waypoint of class speed / (1 + metres missed)."""
    speed = F.coalesce(F.create_map(*[F.lit(x) for kv in CLASS_KPH.items() for x in kv])[F.col("highway")], F.lit(OTHER_KPH))
    weight = speed / (1 + F.col("dist_m"))
    return candidates.withColumn("prior", weight / F.sum(weight).over(W.partitionBy("run_id", "group", "wp")))


@dataclass
class Option:
    """A candidate edge of a waypoint, by node number, with what choosing it costs."""

    src: int
    dst: int
    cost: float


class Legs:
    """Ways from edge to edge over a graph, each found once for all runs that need it, up to so many."""

    def __init__(self, g: Csr, pos: np.ndarray, most: int = 200_000):
        self.g, self.pos, self.most = g, pos, most
        self.known: dict[tuple[int, int, int, int], tuple[float, float, list[int]] | None] = {}
        self.seconds: dict[tuple[int, int], float] = {}

    def edge(self, u: int, v: int) -> float:
        if (u, v) not in self.seconds:
            a, b = self.g.begin[u], self.g.begin[u + 1]
            for w, x in zip(self.g.head[a:b].tolist(), self.g.weight[a:b].tolist(), strict=True):
                self.seconds[u, w] = min(x, self.seconds.get((u, w), math.inf))
        return self.seconds[u, v]

    def between(self, before: list[Option], now: list[Option]) -> dict[tuple[int, int, int, int], tuple[float, float, list[int]] | None]:
        """(seconds of the ride with the second edge, of its turns, nodes after the first edge's start) by the nodes of both edges; None if there is no way."""
        if len(self.known) > self.most:
            self.known.clear()
        lacking: dict[int, list[tuple[Option, Option]]] = {}
        for p in before:
            for o in now:
                if (p.src, p.dst) != (o.src, o.dst) and (p.src, p.dst, o.src, o.dst) not in self.known:
                    lacking.setdefault(p.dst, []).append((p, o))
        for v, both in lacking.items():
            dist, pred = self.g.dijkstra(v, {o.src for _, o in both})
            for p, o in both:
                leg = None
                if o.src in dist:
                    way = self.g.path(pred, v, o.src)
                    nodes = [p.src, *way, o.dst]
                    turns = sum(_turn(self.pos[a], self.pos[b], self.pos[c]) for a, b, c in zip(nodes, nodes[1:], nodes[2:], strict=False))
                    leg = dist[o.src] + self.edge(o.src, o.dst), turns, [*way, o.dst]
                self.known[p.src, p.dst, o.src, o.dst] = leg
        return self.known


def viterbi(layers: list[list[Option]], g: Csr, pos: np.ndarray, best: int = 1, shortest: list[float] | None = None, shared: Legs | None = None) -> list[tuple[float, list[int], list[int]]]:
    """The `best` cheapest choices of one option a waypoint, as (cost, chosen options, path of nodes); fewer if there are fewer.
    `shortest` gets the least seconds of the first edge, and of each step from waypoint to waypoint. `shared`: legs that other runs on this graph have found.

    Each option keeps its `best` cheapest ways to come there, each from an option before and its rank, so that no
    choice comes twice. Equal costs stand in the order of options.
    """
    shared = shared or Legs(g, pos)
    edge = shared.edge
    # entries of an option: (cost, option before, its rank); legs: nodes between two options
    entries = [[[(o.cost + edge(o.src, o.dst), -1, 0)] for o in layers[0]]]
    shortest = [] if shortest is None else shortest
    shortest.append(min(edge(o.src, o.dst) for o in layers[0]))
    legs: list[dict[tuple[int, int], list[int]]] = []
    for before, now in zip(layers, layers[1:], strict=False):
        ways = shared.between([o for o, e in zip(before, entries[-1], strict=True) if e], now)
        new, leg = [], {}
        shortest.append(math.inf)
        for j, o in enumerate(now):
            found = []
            for i, (p, known) in enumerate(zip(before, entries[-1], strict=True)):
                if not known:
                    continue
                if (p.src, p.dst) == (o.src, o.dst):
                    step, leg[i, j] = o.cost, []
                    shortest[-1] = 0.0
                else:
                    found_leg = ways[p.src, p.dst, o.src, o.dst]
                    if found_leg is None:
                        continue
                    ride, turns, way = found_leg
                    step, leg[i, j] = o.cost + ride + turns, way
                    shortest[-1] = min(shortest[-1], ride)
                found += [(cost + step, i, r) for r, (cost, _, _) in enumerate(known)]
            new.append(heapq.nsmallest(best, found))
        entries.append(new)
        legs.append(leg)
    out = []
    for cost, at, rank in heapq.nsmallest(best, [(e[0], j, r) for j, known in enumerate(entries[-1]) for r, e in enumerate(known)]):
        chosen = [at]
        for layer in reversed(entries[1:]):
            _, at, rank = layer[at][rank]
            chosen.append(at)
        chosen.reverse()
        path = [layers[0][chosen[0]].src, layers[0][chosen[0]].dst]
        for leg, i, j in zip(legs, chosen, chosen[1:], strict=False):
            path += leg[i, j][1:] if leg[i, j] else []
        out.append((cost, chosen, path))
    return out


MATCHED = "run_id string, group int, rank int, match_id string, waypoints_used array<int>, active_edges array<struct<src:long,dst:long>>, path array<long>, geo_path array<struct<lat:double,lon:double>>, cost double, halo_m double, proven boolean"


def _place(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, seconds (the least of parallel edges), and both places; an end without a place raises."""
    one = with_time(edges).groupBy("src", "dst").agg(F.min("seconds").alias("seconds"))
    at = lambda k, a: nodes.select(F.col("id").alias(k), F.col("lat").alias(f"{a}lat"), F.col("lon").alias(f"{a}lon")).dropDuplicates([k])
    out = written(one.join(at("src", "a"), "src", "left").join(at("dst", "b"), "dst", "left"))
    if not out.where("alat is null or alon is null or blat is null or blon is null").isEmpty():
        raise ValueError("an edge has an end without a place")
    return out


def _tiles(lat: Column, lon: Column, side_m: float, max_lat: float) -> Column:
    x, y = spatial.cells(lat, lon, side_m, max_lat)
    return F.struct(x.alias("x"), y.alias("y"))


def match(
    groups: DataFrame, candidates: DataFrame, edges: DataFrame, nodes: DataFrame, stubborn: float = STUBBORN, max_miss_m: float = MAX_MISS_M,
    best: int = 1, prior_s: float = 0.0, halo_m: float = 500.0,
) -> DataFrame:
    """groups (run_id, group) and candidates (run_id, group, wp, src, dst, dist_m) to the `best` cheapest matches of each group, ranked.

    The graph is dealt to tiles; a group gets the tiles around the ends of its candidate edges, at least halo_m far. A way out of
    them and back takes at least 2 * halo_m at the fastest straight speed of any edge. If a match with one such step, and the shortest of
    all other steps, costs more than the last of the matches found, these are the matches in the whole graph; other groups are matched
    again with twice the halo. So results do not depend on halo_m, and no task holds more of the graph than its groups need.

    prior_s: seconds that an edge costs for each time that its prior share is e times less than one (0: priors do not matter); candidates
    need `highway` then. A group with a waypoint farther than max_miss_m from every candidate is dropped, as off the graph; candidates that
    are no edges are left out, and a waypoint without any other is not used. Groups whose candidates are not connected get no match, after
    the halo has reached the whole graph: take the largest component first. Equal rows count once; no groups give no rows.
    """
    keys = ["run_id", "group"]
    with scratch() as keep:
        ways = _place(edges, nodes)
        straight = geo.great_circle(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
        every = [f(F.col(f"{e}{c}")) for c in ("lat", "lon") for f in (F.min, F.max) for e in "ab"]
        speed, *limits = ways.agg(F.max(straight / F.col("seconds")), *every).first()
        if speed is None:  # no edges
            return keep(groups.sparkSession.createDataFrame([], MATCHED)).drop("proven")
        lat, lon = limits[:4], limits[4:]
        extent = 111_320.0 * math.hypot(max(lat) - min(lat), max(lon) - min(lon)) + 1.0  # no arc is longer
        max_lat = min(89.0, max(map(abs, lat)) + 1.0)
        cost = F.lit(stubborn * 5 / 1.5) * F.col("dist_m")
        wanted = candidates.join(groups.select(*keys).distinct(), keys, "left_semi")
        if prior_s:
            wanted = prior(wanted.distinct()).withColumn("_prior", F.lit(-prior_s) * F.log("prior"))
            cost = cost + F.col("_prior")
        far = wanted.groupBy(*keys, "wp").agg(F.min("dist_m").alias("d")).where(F.col("d") > max_miss_m).select(*keys).distinct()
        options = wanted.withColumn("cost", cost).select(*keys, "wp", "src", "dst", "cost", "dist_m").distinct()
        left = written(options.join(far, keys, "left_anti").join(ways.select("src", "dst", "alat", "alon", "blat", "blon"), ["src", "dst"]))
        done: list[DataFrame] = []
        while not left.isEmpty():
            whole = halo_m >= extent
            ends = left.select(*keys, F.explode(F.array(F.struct(F.col("alat").alias("lat"), F.col("alon").alias("lon")), F.struct(F.col("blat").alias("lat"), F.col("blon").alias("lon")))).alias("p")).distinct()
            tile = _tiles(F.col("p.lat"), F.col("p.lon"), halo_m, max_lat)
            around = spatial._around(ends, tile["x"], tile["y"]).select(*keys, F.col("_c.x").alias("x"), F.col("_c.y").alias("y")).distinct()
            # groups of the same tiles are a block, dealt by so many; each part of a block gets its piece of the graph once
            tiles = written(around.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("tiles")).withColumn("block", F.sha2(F.to_json("tiles"), 256)))
            blocks = written(tiles.groupBy("block").agg(F.first("tiles").alias("tiles"), F.ceil(F.count("*") / RUNS).alias("parts")))
            own = tiles.join(blocks.select("block", "parts"), "block").select(*keys, "block", F.pmod(F.xxhash64(*keys), F.col("parts")).alias("salt"))
            dealt = ways.withColumn("_t", F.explode(F.array_distinct(F.array(*[_tiles(F.col(f"{e}lat"), F.col(f"{e}lon"), halo_m, max_lat) for e in "ab"])))).select("*", "_t.x", "_t.y").drop("_t")
            part = blocks.select("block", "parts", F.explode("tiles").alias("t")).select("block", "parts", "t.x", "t.y").join(dealt, ["x", "y"]).select("block", "parts", "src", "dst", "seconds", "alat", "alon", "blat", "blon").distinct()
            part = part.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), "src", "dst", "seconds", "alat", "alon", "blat", "blon")
            one = _matcher(best, math.inf if whole else 2 * halo_m / speed, halo_m)
            found = written(left.drop("alat", "alon", "blat", "blon").join(own, keys).groupBy("block", "salt").cogroup(part.groupBy("block", "salt")).applyInPandas(one, MATCHED))
            done.append(found.where("proven"))
            if whole:
                break
            left = written(left.join(found.where("not proven").select(*keys), keys, "left_semi"))
            halo_m *= 2
        out = reduce(DataFrame.unionAll, done) if done else groups.sparkSession.createDataFrame([], MATCHED)
        return keep(out.drop("proven"))


def _matcher(best: int, way_out_s: float, halo_m: float):
    names = [c.split()[0] for c in MATCHED.split(", ")]

    def one(_: tuple, options: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(options):
            return pd.DataFrame(columns=names)
        g = Csr(part.src.to_numpy(np.int64), part.dst.to_numpy(np.int64), part.seconds.to_numpy(float))
        pos = np.zeros((len(g.ids), 2))
        for k, e in (("src", "a"), ("dst", "b")):
            pos[np.searchsorted(g.ids, part[k].to_numpy(np.int64))] = part[[f"{e}lat", f"{e}lon"]].to_numpy(float)
        legs, out = Legs(g, pos), []
        rows = options.sort_values(["run_id", "group", "wp", "dist_m", "src", "dst"])
        numbers = [np.searchsorted(g.ids, rows[c].to_numpy(np.int64)).tolist() for c in ("src", "dst")]
        for key, run in itertools.groupby(zip(rows.run_id.tolist(), rows.group, rows.wp.tolist(), *numbers, rows.cost.tolist(), strict=True), lambda r: r[:2]):
            by_wp = [(wp, [Option(u, v, c) for *_, u, v, c in w]) for wp, w in itertools.groupby(run, lambda r: r[2])]
            out += match_one(key, [wp for wp, _ in by_wp], [layer for _, layer in by_wp], g, pos, legs)
        return pd.DataFrame(out, columns=names)

    def match_one(key: tuple, wps: list[int], layers: list[list[Option]], g: Csr, pos: np.ndarray, legs: Legs) -> list[tuple]:
        shortest: list[float] = []
        found = viterbi(layers, g, pos, best, shortest, legs)
        # no choice of which a step leaves the tiles is cheaper than this: that step takes the way out and back, each other one at least its least
        steps = [min(s, way_out_s) for s in shortest[1:]] or [0.0]
        bound = sum(min(o.cost for o in layer) for layer in layers) + shortest[0] + sum(steps) - max(steps) + way_out_s
        all_of_them = min(best, math.prod(map(len, layers)))
        if way_out_s < math.inf and (len(found) < all_of_them or found[-1][0] >= bound):
            return [(*key, *[None] * (len(names) - 4), halo_m, False)]
        out = []
        for rank, (cost, chosen, path) in enumerate(found, 1):
            active = [{"src": int(g.ids[o.src]), "dst": int(g.ids[o.dst])} for o in (layer[i] for layer, i in zip(layers, chosen, strict=True))]
            ids = [int(g.ids[i]) for i in path]
            name = hashlib.sha256(f"{VERSION}{key}{active}{ids}".encode()).hexdigest()
            out.append((key[0], key[1], rank, name, wps, active, ids, [{"lat": pos[i][0], "lon": pos[i][1]} for i in path], cost, halo_m, True))
        return out

    return one


def pending(groups: DataFrame, done: DataFrame) -> DataFrame:
    """Groups without a result yet, so that a repeated job goes on where it ended."""
    return groups.join(done.select("run_id", "group").distinct(), ["run_id", "group"], "left_anti")
