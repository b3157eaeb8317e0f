"""Point-to-point distances by hub labels: any number of pairs is one join and a minimum.

Nodes are dealt to cells along a space-filling curve. A task works out all pairs within a cell and takes out the nodes
without an arc to another cell; between those that stay, arcs take the place of the paths through the cell. Then two
cells make one, and so on until a single cell is left: rounds go with the logarithm of the number of cells. Labels go down
from the last round: the hubs of a node that a round took out are some of those that its cell took out with it, and those of
the nodes that stayed, at the distance to them more. Hubs that another one makes needless within the cell are left out.

The highest node of a shortest path is a hub of both its ends, with exact distances. Arcs remember the node that they
were made over, by which paths are unrolled in rounds.

A cell holds as many nodes as stay of both its parts. On road networks that goes with the square root of the nodes in its area; a
graph whose arcs lead anywhere keeps all nodes up to the last cell, which then holds the square of their number: such graphs are
not for this.

Defined cases: weights must not be negative; loops are left out, of parallel edges the shortest stays; null ends or weights
are no edges; equal pairs count once; a node is at 0 from itself if it is on the graph; pairs that are not connected get no row; an
empty graph connects nothing; nodes without a place stand at the curve's beginning; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import scratch, written
from .graph import numbered

#: Nodes of a cell in the first round.
CELL = 256


@dataclass
class Labels:
    """labels: direction ('out': from node to hub, 'in': from hub to node), node, hub, dist, via (the next node above; null for the node itself), level (of the arc to it); arcs: level, src, dst, mid (null: an arc of the level `base`, -1 for an edge)."""

    labels: DataFrame
    arcs: DataFrame
    rounds: int


def curve(nodes: DataFrame, bits: int = 24) -> DataFrame:
    """nodes (id, lat, lon) with `code`: the place along a space-filling curve over the square around them. One scale for both axes, so that a cell of a long and narrow network is no strip along all of it."""
    low = nodes.agg(F.min("lat").alias("_lat"), F.min("lon").alias("_lon"), F.greatest(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("_side"))
    steps = (1 << bits) - 1
    at = lambda c: F.coalesce(F.floor((F.col(c) - F.col(f"_{c}")) / F.nullif(F.col("_side"), F.lit(0.0)) * steps), F.lit(0)).cast("long")
    spread = lambda c, k: F.shiftleft(F.shiftright(c, k).bitwiseAND(1), 2 * k)
    code = lambda x, y: sum((spread(x, k) + 2 * spread(y, k) for k in range(bits)), F.lit(0).cast("long"))
    return nodes.crossJoin(F.broadcast(low)).withColumns({"_x": at("lon"), "_y": at("lat")}).select("id", code(F.col("_x"), F.col("_y")).alias("code"))  # one row


CELL_ROWS = "kind string, a long, b long, ra long, rb long, dist double, mid long, base int, stays boolean"


def solve_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (src, dst, rs, rd, w, base) of a cell, those with src = dst naming a node with an arc to another cell, to rows of kind 'arc' (all connected pairs a, b with the node between them; stays: both stay) and 'out' or 'in' (hub b of node a, which is taken out; stays: the hub stays)."""
    own = pdf[pdf.src != pdf.dst]
    ids, first = np.unique(np.concatenate([pdf.src, pdf.dst]).astype(np.int64), return_index=True)
    rank = np.concatenate([pdf.rs, pdf.rd]).astype(np.int64)[first]
    n = len(ids)
    stays = np.isin(ids, pdf.src[pdf.src == pdf.dst].to_numpy(np.int64))
    s, t = np.searchsorted(ids, own.src), np.searchsorted(ids, own.dst)
    d, base = np.full((n, n), np.inf), np.full((n, n), -1)
    d[s, t], base[s, t] = own.w, own.base
    mid = np.full((n, n), -1)  # number of the node between, -1: an arc
    np.fill_diagonal(d, 0.0)
    changed = True
    while changed:  # paths of up to twice as many arcs each time
        changed, before, back = False, d.copy(), d.T.copy()
        for i in range(n):
            sums = before[i] + back  # a row for each end, its sums over the nodes between
            new = sums.min(axis=1)
            better = new < d[i]
            if better.any():
                d[i, better], mid[i, better], changed = new[better], sums[better].argmin(axis=1), True
    # as hubs, nodes that stay come first, then those that most shortest paths go through
    finite = np.isfinite(d)
    through = np.array([np.count_nonzero((d[:, g, None] + d[None, g] <= d) & finite) for g in range(n)])
    best, rows = np.full((n, n), np.inf), []
    for h in np.lexsort((ids, -through, ~stays)):
        for kind, to, had in (("out", d[:, h], best[:, h]), ("in", d[h], best[h])):
            v = np.flatnonzero((to < had) & ~stays)
            rows.append(pd.DataFrame({"kind": kind, "a": ids[v], "b": ids[h], "ra": rank[v], "rb": rank[h], "dist": to[v], "stays": stays[h]}))
        np.minimum(best, d[:, h, None] + d[None, h], out=best)
    a, b = np.nonzero(finite & ~np.eye(n, dtype=bool))
    arcs = pd.DataFrame({"kind": "arc", "a": ids[a], "b": ids[b], "ra": rank[a], "rb": rank[b], "dist": d[a, b], "mid": pd.array(ids[mid[a, b]], "Int64"), "base": pd.array(base[a, b], "Int32"), "stays": stays[a] & stays[b]})
    arcs["mid"] = arcs.mid.mask(mid[a, b] < 0)
    out = pd.concat([arcs, *[r.assign(mid=pd.array([None] * len(r), "Int64"), base=pd.array([None] * len(r), "Int32")) for r in rows if len(r)]])
    return out[[c.split()[0] for c in CELL_ROWS.split(", ")]]


def _selves(nodes: DataFrame) -> DataFrame:
    """Labels of nodes by themselves."""
    return nodes.select(F.explode(F.array(F.lit("out"), F.lit("in"))).alias("direction"), "node", F.col("node").alias("hub"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("via"), F.lit(0).alias("level"))


def build(edges: DataFrame, nodes: DataFrame, weight: str = "len_m", cell: int = CELL) -> Labels:
    """edges (src, dst, weight), nodes (id, lat, lon) to Labels, in tables that stay until the checkpoint folder goes (or a scope around this ends)."""
    with scratch() as keep:
        clean = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(weight).cast("double").alias("w"))
        if not clean.where("w < 0").isEmpty():
            raise ValueError("weights must not be negative")
        ends = written(clean.select(F.col("src").alias("id")).unionAll(clean.select("dst")).where("id is not null").distinct())
        placed = curve(ends.join(nodes.select(F.col("id").cast("long").alias("id"), "lat", "lon").dropDuplicates(["id"]), "id", "left"))
        rank = written(numbered(placed.withColumn("_one", F.lit(1)), ["code", "id"], "_one", "rank").select("id", F.col("rank").cast("long").alias("rank")))
        n = rank.count()
        arcs = clean.where("src <> dst and w is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))
        arcs = arcs.join(rank.select(F.col("id").alias("src"), F.col("rank").alias("rs")), "src").join(rank.select(F.col("id").alias("dst"), F.col("rank").alias("rd")), "dst")
        arcs = written(arcs.select("src", "dst", "rs", "rd", "w", F.lit(-1).alias("base")))
        rounds: list[DataFrame] = []
        while not arcs.isEmpty():
            of = lambda r: F.floor(F.col(r) / cell)  # noqa: E731, B023
            within = of("rs") == of("rd")
            mine = arcs.where(within).select(of("rs").alias("cell"), "src", "dst", "rs", "rd", "w", "base")
            across = arcs.where(~within)
            marks = across.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("rs").alias("r")), F.struct(F.col("dst").alias("id"), F.col("rd").alias("r")))).alias("m")).distinct()
            marks = marks.select(F.floor(F.col("m.r") / cell).alias("cell"), F.col("m.id").alias("src"), F.col("m.id").alias("dst"), F.col("m.r").alias("rs"), F.col("m.r").alias("rd"), F.lit(0.0).alias("w"), F.lit(-1).alias("base"))
            done = written(mine.unionAll(marks).groupBy("cell").applyInPandas(solve_cell, CELL_ROWS))
            over = done.where("kind = 'arc' and stays").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("ra").alias("rs"), F.col("rb").alias("rd"), F.col("dist").alias("w"), F.lit(len(rounds)).alias("base"))
            rounds.append(done)
            arcs = written(across.unionAll(over))
            if cell >= n:
                break
            cell *= 2
        labels: list[DataFrame] = []
        for level in reversed(range(len(rounds))):
            hubs = rounds[level].where("kind <> 'arc'").select(F.col("kind").alias("direction"), F.col("a").alias("node"), F.col("b").alias("hub"), "dist", "stays")
            ahead = hubs.where("not stays").select("direction", "node", "hub", "dist", F.when(F.col("node") != F.col("hub"), F.col("hub")).alias("via"))
            if labels:
                known = reduce(DataFrame.unionAll, labels).select("direction", F.col("node").alias("via"), "hub", F.col("dist").alias("more"))
                up = hubs.where("stays").select("direction", "node", F.col("hub").alias("via"), "dist").join(known, ["direction", "via"])
                best = F.min(F.struct((F.col("dist") + F.col("more")).alias("dist"), "via")).alias("m")
                ahead = ahead.unionAll(up.groupBy("direction", "node", "hub").agg(best).select("direction", "node", "hub", "m.dist", "m.via"))
            labels.append(written(ahead.withColumn("level", F.lit(level))))
        alone = _selves(ends.select(F.col("id").alias("node")))
        if labels:
            every = reduce(DataFrame.unionAll, labels)
            alone = alone.join(every.select("node").distinct(), "node", "left_anti").select(*every.columns)
            found = keep(every.unionAll(alone))
        else:
            found = keep(alone)
        unrolled = [r.where("kind = 'arc'").select(F.lit(i).alias("level"), F.col("a").alias("src"), F.col("b").alias("dst"), "mid", "base") for i, r in enumerate(rounds)]
        nothing = found.where("false").select("level", F.col("node").alias("src"), F.col("hub").alias("dst"), F.col("via").alias("mid"), F.lit(-1).alias("base"))
        return Labels(found, keep(reduce(DataFrame.unionAll, [nothing, *unrolled])), len(rounds))


def _met(pairs: DataFrame, found: Labels) -> DataFrame:
    """(u, v, length, hub) of the distinct pairs that are connected."""
    asked = pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct()
    out = found.labels.where("direction = 'out'").select(F.col("node").alias("u"), "hub", F.col("dist").alias("d1"))
    into = found.labels.where("direction = 'in'").select(F.col("node").alias("v"), "hub", F.col("dist").alias("d2"))
    best = F.min(F.struct((F.col("d1") + F.col("d2")).alias("length"), "hub")).alias("m")
    return asked.join(out, "u").join(into, ["v", "hub"]).groupBy("u", "v").agg(best).select("u", "v", "m.length", "m.hub")


def distances(pairs: DataFrame, found: Labels) -> DataFrame:
    """pairs (u, v) to (u, v, length) for those that are connected."""
    return _met(pairs, found).select("u", "v", "length")


def paths(pairs: DataFrame, found: Labels) -> DataFrame:
    """pairs (u, v) to (u, v, path, length): up to the hub and down again by the labels, then every arc by the nodes and arcs it was made over."""
    with scratch() as keep:
        met = written(_met(pairs, found))
        step = found.labels.select("direction", "node", "hub", "via", "level")
        # arcs in order: `at` sorts them, the way down is found backwards
        arcs: list[DataFrame] = []
        for direction, end in (("out", "u"), ("in", "v")):
            go = met.select("u", "v", "hub", F.col(end).alias("node"))
            up, k = step.where(F.col("direction") == direction).drop("direction"), 0
            while True:
                go = written(go.join(up, ["node", "hub"]).where("via is not null"))
                if go.isEmpty():
                    break
                at = F.lit(f"a{k:06d}." if direction == "out" else f"b{999_999 - k:06d}.")
                src, dst = ("node", "via") if direction == "out" else ("via", "node")
                arcs.append(go.select("u", "v", at.alias("at"), "level", F.col(src).alias("src"), F.col(dst).alias("dst")))
                go, k = go.select("u", "v", "hub", F.col("via").alias("node")), k + 1
        done: list[DataFrame] = []
        left = reduce(DataFrame.unionAll, arcs) if arcs else None
        while left is not None:
            over = written(left.join(found.arcs, ["level", "src", "dst"]))
            done.append(over.where("mid is null and base < 0").select("u", "v", "at", "dst"))
            left = over.where("mid is not null or base >= 0")
            if left.isEmpty():
                break
            part = lambda k, src, dst: F.struct(F.concat("at", F.lit(k)).alias("at"), F.col("level").alias("level"), F.col(src).alias("src"), F.col(dst).alias("dst"))
            halves = F.array(part("0", "src", "mid"), part("1", "mid", "dst"))
            lower = F.array(F.struct(F.col("at").alias("at"), F.col("base").alias("level"), F.col("src").alias("src"), F.col("dst").alias("dst")))
            left = left.select("u", "v", F.explode(F.when(F.col("mid").isNotNull(), halves).otherwise(lower)).alias("h")).select("u", "v", "h.*")
        if not done:
            return keep(met.select("u", "v", F.array("u").alias("path"), "length"))
        nodes = reduce(DataFrame.unionAll, done).groupBy("u", "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "dst"))), lambda x: x["dst"]).alias("rest"))
        return keep(met.join(nodes, ["u", "v"], "left").select("u", "v", F.concat(F.array("u"), F.coalesce("rest", F.slice(F.array("u"), 1, 0))).alias("path"), "length"))
