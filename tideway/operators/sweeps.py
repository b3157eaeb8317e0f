"""Distances from some sources to many nodes, by nested cells that are swept up and down again.

Nodes are dealt to cells along a space-filling curve. Going up, a task works out the distances between the nodes of its cell that have
an arc to another one; these stay, arcs that no other two replace take the place of the paths through the cell, and some cells make one. Each
source goes up with its own cell: its distances to the nodes that stay. Going down, the distances of a source to the nodes that stay
in a cell give those to all nodes of the cell. So rounds go with the logarithm of the number of cells, no task holds more than a cell (and some of the
sources' distances to it), and the work beside the cells' goes with the sources times the nodes of the cells that are asked for.

`hub_labels` is for other asks: many sources with few targets each. Trees of all shortest paths of a source hold a row a node, however long
the paths are.

Defined cases: weights must not be negative (trees: must be positive, and not vanish beside the distances); loops are left out, of parallel edges the shortest stays; null ends or weights
are no edges; equal pairs count once; a node is at 0 from itself if it is on the graph; pairs that are not connected get no row; nodes without a
place stand at the curve's beginning.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import scratch, written
from .graph import numbered
from .hub_labels import curve

#: Nodes of a cell in the first round, cells that make one in the next, and sources whose distances go to a cell at once.
CELL, RATIO, SOURCES = 256, 4, 4096


def _closed(n: int, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances between all nodes of a cell."""
    d = np.full((n, n), np.inf)
    np.minimum.at(d, (s, t), w)
    np.fill_diagonal(d, 0.0)
    for k in range(n):
        np.minimum(d, d[:, k, None] + d[k], out=d)
    return d


def _needed(d: np.ndarray) -> np.ndarray:
    """Pairs whose distance is not that of two shorter ones."""
    needed = np.isfinite(d)
    np.fill_diagonal(needed, False)
    for k in range(len(d)):
        a, b = d[:, k, None], d[k]
        needed &= ~((a + b <= d) & (a < d) & (b < d))
    return needed


def _spread(known: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray, closed: np.ndarray | None = None) -> np.ndarray:
    """known (a row a source, inf: not known) to the distances to all nodes of the cell."""
    n = known.shape[1]
    if closed is None and len(known) * (len(s) + n) * 1500 < n**3:  # a search a source is less work
        order = np.argsort(s, kind="stable")
        begin, head, weight = np.searchsorted(s[order], np.arange(n + 1)).tolist(), t[order].tolist(), w[order].tolist()
        return np.array([_search(row, begin, head, weight) for row in known.tolist()]).reshape(known.shape)
    closed = _closed(n, s, t, w) if closed is None else closed
    out = known.copy()
    for k in np.flatnonzero(np.isfinite(known).any(axis=0)):
        np.minimum(out, known[:, k, None] + closed[k], out=out)
    return out


def _search(dist: list[float], begin: list[int], head: list[int], weight: list[float]) -> list[float]:
    heap = [(d, v) for v, d in enumerate(dist) if d < float("inf")]
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for i in range(begin[v], begin[v + 1]):
            if d + weight[i] < dist[head[i]]:
                dist[head[i]] = d + weight[i]
                heapq.heappush(heap, (d + weight[i], head[i]))
    return dist


class _Cell:
    """Rows (s, t, w) of a cell, those with s = t naming a node with an arc to another cell, and known (u, node, d)."""

    def __init__(self, rows: pd.DataFrame, known: pd.DataFrame):
        own = rows[rows.s != rows.t]
        self.ids = np.unique(np.concatenate([rows.s, rows.t, known.node]).astype(np.int64))
        at = lambda x: np.searchsorted(self.ids, np.asarray(x, np.int64))
        self.arcs = at(own.s), at(own.t), own.w.to_numpy(float)
        self.stays = at(np.unique(rows.s[rows.s == rows.t]))
        self.us = np.unique(known.u.to_numpy(np.int64))
        self.known = np.full((len(self.us), len(self.ids)), np.inf)
        np.minimum.at(self.known, (np.searchsorted(self.us, known.u.to_numpy(np.int64)), at(known.node)), known.d.to_numpy(float))


def _up(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Arcs (a, b, d) between the nodes that stay, for the first sources only; and (u, a, d) of the sources to them."""
    c = _Cell(rows, known)
    stays = c.ids[c.stays]
    closed = _closed(len(c.ids), *c.arcs)
    out = []
    if key[1] == 0:
        d = closed[np.ix_(c.stays, c.stays)]
        a, b = np.nonzero(_needed(d))
        out.append(pd.DataFrame({"u": pd.array([None] * len(a), "Int64"), "a": stays[a], "b": stays[b], "d": d[a, b]}))
    if len(c.us):
        d = _spread(c.known, *c.arcs, closed)[:, c.stays]
        i, a = np.nonzero(np.isfinite(d))
        out.append(pd.DataFrame({"u": pd.array(c.us[i], "Int64"), "a": stays[a], "b": stays[a], "d": d[i, a]}))
    return pd.concat(out) if out else pd.DataFrame({"u": [], "a": [], "b": [], "d": []})


def _down(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """(u, node, d) of all nodes of the cell."""
    if not len(known):
        return pd.DataFrame({"u": [], "node": [], "d": []})
    c = _Cell(rows, known)
    d = _spread(c.known, *c.arcs)
    i, v = np.nonzero(np.isfinite(d))
    return pd.DataFrame({"u": c.us[i], "node": c.ids[v], "d": d[i, v]})


@dataclass
class _Swept:
    """found (u, node: its rank, d), rank (id, rank), arcs (src, dst, w)."""

    found: DataFrame
    rank: DataFrame
    arcs: DataFrame


def _sweep(sources: DataFrame, edges: DataFrame, nodes: DataFrame, weight: str, cell: int, pairs: DataFrame | None = None) -> _Swept:
    """sources (u), those of the pairs (u, v) if they are stated: then only cells with a v of a u are asked for it. Tables belong to the scope around this."""
    clean = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(weight).cast("double").alias("w"))
    clean = written(clean.where("src is not null and dst is not null and w is not null").groupBy("src", "dst").agg(F.min("w").alias("w")))
    if not clean.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    ends = clean.select(F.col("src").alias("id")).unionAll(clean.select("dst")).distinct()
    placed = curve(written(ends.join(nodes.select(F.col("id").cast("long").alias("id"), "lat", "lon").dropDuplicates(["id"]), "id", "left")))
    rank = written(numbered(placed.withColumn("_one", F.lit(1)), ["code", "id"], "_one", "rank").select("id", F.col("rank").cast("long").alias("rank")))
    n = rank.count()
    place = lambda k, r: rank.select(F.col("id").alias(k), F.col("rank").alias(r))
    arcs = written(clean.where("src <> dst").join(place("src", "s"), "src").join(place("dst", "t"), "dst").select("s", "t", "w"))
    ups = [written(sources.select(F.col("u").cast("long").alias("u")).distinct().join(place("u", "node"), "u").select("u", "node", F.lit(0.0).alias("d")))]
    parts = -(-ups[0].count() // SOURCES)
    asked = None if pairs is None else pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).join(place("v", "node"), "v").select("u", "node")

    of = lambda c, size: F.floor(F.col(c) / size).alias("cell")
    salt = F.pmod(F.xxhash64("u"), F.lit(max(parts, 1))).alias("salt")

    def solved(rows: DataFrame, known: DataFrame, size: int, f, schema: str) -> DataFrame:
        dealt = rows.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 1) - 1).cast("long"))).alias("salt"), "s", "t", "w")
        mine = known.select(of("node", size), salt, "u", "node", "d")
        return written(dealt.groupBy("cell", "salt").cogroup(mine.groupBy("cell", "salt")).applyInPandas(f, schema))

    levels: list[tuple[int, DataFrame]] = []
    size = cell
    while True:
        within = of("s", size) == of("t", size)
        across = arcs.where(~within)
        marks = across.select(F.explode(F.array("s", "t")).alias("s")).distinct().select(of("s", size), "s", F.col("s").alias("t"), F.lit(0.0).alias("w"))
        rows = written(arcs.where(within).select(of("s", size), "s", "t", "w").unionAll(marks))
        levels.append((size, rows))
        if size >= n:
            break
        done = solved(rows, ups[-1], size, _up, "u long, a long, b long, d double")
        arcs = written(across.unionAll(done.where("u is null").select("a", "b", "d")))
        ups.append(done.where("u is not null").select("u", F.col("a").alias("node"), "d"))
        size *= RATIO
    found = None
    for (size, rows), up in zip(reversed(levels), reversed(ups), strict=True):
        known = up if found is None else up.unionAll(found)
        if asked is not None:
            some = asked.select("u", of("node", size)).distinct()
            known = known.withColumn("cell", of("node", size)).join(some, ["u", "cell"], "left_semi").select("u", "node", "d")
        found = solved(rows, known, size, _down, "u long, node long, d double")
    return _Swept(found, rank, clean)


def distances(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, weight: str = "len_m", cell: int = CELL) -> DataFrame:
    """pairs (u, v), edges (src, dst, weight), nodes (id, lat, lon) to (u, v, length) of the distinct pairs that are connected."""
    with scratch() as keep:
        one = written(pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct())
        swept = _sweep(one.select("u"), edges, nodes, weight, cell, one)
        asked = one.join(swept.rank.select(F.col("id").alias("v"), F.col("rank").alias("node")), "v")
        return keep(asked.join(swept.found, ["u", "node"]).select("u", "v", F.col("d").alias("length")))


def trees(sources: DataFrame, edges: DataFrame, nodes: DataFrame, weight: str = "len_m", cell: int = CELL) -> DataFrame:
    """sources (u) to (u, node, pred, dist): for each node that u reaches the node before it on a shortest path (of equal ones the smallest id; null for u itself) and the distance.

    All shortest paths of a source in a row a node. Every row is held against the row before it: its distance is that one's and the edge's, so it is the
    sum of the edges of the path back to u. Where it is not (weights that vanish beside the distances), this raises.
    """
    with scratch() as keep:
        swept = _sweep(sources, edges, nodes, weight, cell)
        if not swept.arcs.where("w <= 0 and src <> dst").isEmpty():
            raise ValueError("weights must be positive")
        found = written(swept.found.join(swept.rank.select(F.col("rank").alias("node"), "id"), "node").select("u", F.col("id").alias("node"), F.col("d").alias("dist")))
        ways = swept.arcs.where("src <> dst").select(F.col("src").alias("node"), "dst", "w")
        ahead = found.join(ways, "node").groupBy("u", F.col("dst").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("sum"), F.col("node").alias("pred"), F.col("dist").alias("before"))).alias("m"))
        both = found.join(ahead, ["u", "node"], "left")
        sound = (F.col("m.before") < F.col("dist")) & (F.abs(F.col("m.sum") - F.col("dist")) <= 1e-9 * F.col("dist"))
        pred = F.when(F.col("node") == F.col("u"), F.lit(None)).when(sound, F.col("m.pred")).otherwise(F.raise_error("a distance is not that of the node before it and the edge").cast("long"))
        return keep(both.select("u", "node", pred.alias("pred"), "dist"))
