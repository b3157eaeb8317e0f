"""Road graphs as two tables, nodes (id, lat, lon) and directed edges (src, dst, len_m, ...), and path search over them."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import checkpointed, scratch, written
from ..functions import geo

#: Edges up to which a graph is sent to every task, as arrays of 16 bytes an edge (160 MB).
MAX_SENT_EDGES = 10_000_000


def way_edges(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (id, tags, node_ids) to edges: consecutive nodes, the reverse too unless oneway is yes (any case)."""
    n = F.size("node_ids")
    steps = F.zip_with(F.slice("node_ids", 1, F.greatest(n - 1, F.lit(0))), F.slice("node_ids", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    one = ways.select(F.col("id").alias("way_id"), "tags", F.explode(steps).alias("e")).select("way_id", "tags", "e.src", "e.dst").where("src <> dst")
    back = one.where(F.coalesce(F.lower(F.col("tags")["oneway"]), F.lit("no")) != "yes").select("way_id", "tags", F.col("dst").alias("src"), F.col("src").alias("dst"))
    every = one.unionAll(back)
    a, b = (nodes.select(F.col("id").alias(k), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon")) for k in ("src", "dst"))
    placed = every.join(a, "src").join(b, "dst")
    length = geo.great_circle(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon"))
    tag = lambda t: F.col("tags")[t].alias(t)
    return placed.select("src", "dst", length.alias("len_m"), tag("highway"), tag("name"), tag("oneway"), "way_id").groupBy("src", "dst").agg(*[F.min_by(c, "way_id").alias(c) for c in ("len_m", "highway", "name", "oneway")], F.min("way_id").alias("way_id"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).groupBy("a", "b").agg(F.min("len_m").alias("len_m"), F.min("highway").alias("highway"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def _trimmed(edges: DataFrame) -> DataFrame:
    """edges (src, dst) less those at nodes without a way in or out, until none is left out: such a node is a component of its own."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = checkpointed(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(id, colour): the smallest id from which a node can be reached, by rounds of joins from the nodes that changed."""
    nodes = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    known = fresh = checkpointed(nodes.withColumn("colour", F.col("id")))
    while not fresh.isEmpty():
        told = fresh.join(edges.withColumnRenamed("src", "id"), "id").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("told"))
        both = checkpointed(known.join(told, "id", "left").select("id", F.least("colour", "told").alias("colour"), F.coalesce(F.col("told") < F.col("colour"), F.lit(False)).alias("new")))
        known, fresh = both.select("id", "colour"), both.where("new").select("id", "colour")
    return known


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of strongly connected components of two nodes or more, named by their smallest node.

    Nodes take the smallest id that reaches them as colour; those that reach this node within the colour are its
    component. This goes on with the other nodes and the edges within a colour, all components at once.
    """
    found = None
    left = _trimmed(checkpointed(edges.select("src", "dst").where("src <> dst").distinct()))
    while not left.isEmpty():
        colour = _colours(left)
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("d"))
        within = checkpointed(left.join(a, "src").join(b, "dst").where("c = d").select("src", "dst", "c"))
        seen = fresh = checkpointed(within.select(F.col("c").alias("id"), F.col("c").alias("component")).distinct())
        while not fresh.isEmpty():
            step = fresh.join(within.select(F.col("dst").alias("id"), "src"), "id").select(F.col("src").alias("id"), "component").distinct()
            fresh = checkpointed(step.join(seen, "id", "left_anti"))
            seen = checkpointed(seen.unionAll(fresh))
        found = seen if found is None else found.unionAll(seen)
        left = _trimmed(checkpointed(within.join(seen.select(F.col("id").alias("src")), "src", "left_anti").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")))
    return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0) if found is None else found


def largest_component(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(id): nodes of the largest strongly connected component; of equal ones, that with the smallest node.

    `small` is no longer used: graphs of all sizes go the same way.
    """
    found = checkpointed(strong_components(edges))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    best = sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("c")).first()["c"]
    if best is not None:
        return found.where(F.col("component") == F.lit(best)).select("id")
    # no cycle: each node is a component
    return edges.select(F.least(F.min("src"), F.min("dst")).alias("id")).where("id is not null")


def numbered(df: DataFrame, order: list[str], count: str, out: str) -> DataFrame:
    """df with `out`: the sum of `count` over all rows before it, by ranges and then within them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(count).alias("_all"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_all").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum(count).over(w), F.lit(0))).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_part")  # one row a partition


def break_long_edges(nodes: DataFrame, edges: DataFrame, max_m: float = 50.0, tolerance_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with edges over max_m cut into equal parts. Both directions share the new nodes, numbered on from the largest id; they must agree on the length within the tolerance."""
    edges = written(edges)  # read four times
    pair = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    both = pair.groupBy("a", "b").agg(F.max("len_m").alias("len"), (F.max("len_m") - F.min("len_m")).alias("off"), F.ceil(F.max("len_m") / max_m).cast("int").alias("parts")).where("parts > 1")
    if not both.where(F.col("off") > tolerance_m).isEmpty():
        raise ValueError("the directions of an edge differ in length")
    top = nodes.agg(F.max("id")).first()[0]
    ided = numbered(both.select("a", "b", "parts", (F.col("parts") - 1).alias("more")), ["a", "b"], "more", "at")
    pos = lambda k: nodes.select(F.col("id").alias(k), F.col("lat").alias(f"{k}lat"), F.col("lon").alias(f"{k}lon"))
    placed = written(ided.select("a", "b", "parts", "at").join(pos("a"), "a").join(pos("b"), "b"))
    i = F.explode(F.sequence(F.lit(1), F.col("parts") - 1)).alias("i")
    new = placed.select("*", i).select((F.lit(top) + F.col("at") + F.col("i")).cast("long").alias("id"), *[(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("i") / F.col("parts")).alias(c) for c in ("lat", "lon")])
    # one join for all edges, each taken apart only after it: part i of a way goes from its i-th node to the next
    others = [c for c in edges.columns if c not in ("src", "dst", "len_m")]
    n = F.coalesce("parts", F.lit(1))
    steps = pair.join(placed.select("a", "b", "parts", "at"), ["a", "b"], "left").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    x = F.when(F.col("i") == 0, F.col("a")).otherwise((F.lit(top) + F.col("at") + F.col("i")).cast("long"))
    y = F.when(F.col("i") == n - 1, F.col("b")).otherwise((F.lit(top) + F.col("at") + F.col("i") + 1).cast("long"))
    ahead = F.col("src") == F.col("a")
    cut = steps.select(F.when(ahead, x).otherwise(y).alias("src"), F.when(ahead, y).otherwise(x).alias("dst"), (F.col("len_m") / n).alias("len_m"), *others)
    return nodes.select("id", "lat", "lon").unionByName(new), cut


def edge_stats(edges: DataFrame, limits=(5, 10, 20, 50)) -> DataFrame:
    """(max_len, more): nodes that cutting to each length would add."""
    one = undirected(edges)
    sums = one.agg(*[F.sum(F.floor(F.col("len_m") / m)).alias(str(m)) for m in limits])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(m).alias("max_len"), F.col(str(m)).alias("more")) for m in limits])).alias("s")).select("s.*")


def king_grid(spark: SparkSession, xn: int = 8, yn: int = 8, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """A grid with one-way columns and rows of alternating direction: nodes (id, lat, lon: place in the plane), edges.

    Node x * yn + y stands at (x, y). Even columns go up and odd ones down; even rows go to the left and odd ones to the right.
    """
    place = spark.range(xn * yn).select("id", F.floor(F.col("id") / yn).alias("x"), (F.col("id") % yn).alias("y"))
    nodes = place.select("id", (F.col("y") * scale).cast("double").alias("lat"), (F.col("x") * scale).cast("double").alias("lon"))
    columns = place.where(F.col("y") < yn - 1).select(F.col("id").alias("p"), (F.col("id") + 1).alias("q"), (F.col("x") % 2 == 0).alias("on"))
    rows = place.where(F.col("x") < xn - 1).select(F.col("id").alias("p"), (F.col("id") + yn).alias("q"), (F.col("y") % 2 == 1).alias("on"))
    ways = columns.unionAll(rows).select(F.when(F.col("on"), F.col("p")).otherwise(F.col("q")).alias("src"), F.when(F.col("on"), F.col("q")).otherwise(F.col("p")).alias("dst"))
    return nodes, ways.withColumn("len_m", F.lit(float(scale)))


class Csr:
    """A graph as arrays, to be sent to tasks."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst]))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.lexsort((d, s))
        self.head, self.weight = d[order], np.asarray(weight, float)[order]
        self.begin = np.searchsorted(s[order], np.arange(len(self.ids) + 1))

    def number(self, node: int) -> int:
        i = int(np.searchsorted(self.ids, node))
        return i if i < len(self.ids) and self.ids[i] == node else -1

    def dijkstra(self, source: int, targets: set[int] | None = None, banned_nodes=frozenset(), banned_edges=frozenset(), limit: float = float("inf")) -> tuple[dict[int, float], dict[int, int]]:
        """(distance, predecessor) by node number, exact; it ends when all targets are settled."""
        dist, pred, done = {source: 0.0}, {}, set()
        left = None if targets is None else set(targets)
        heap = [(0.0, source)]
        head, weight, begin = self.head, self.weight, self.begin
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            if d > limit:
                break
            done.add(v)
            if left is not None:
                left.discard(v)
                if not left:
                    break
            a, b = begin[v], begin[v + 1]
            for w, x in zip(head[a:b].tolist(), weight[a:b].tolist(), strict=True):
                if w in done or w in banned_nodes or (v, w) in banned_edges:
                    continue
                new = d + x
                if new < dist.get(w, float("inf")):
                    dist[w], pred[w] = new, v
                    heapq.heappush(heap, (new, w))
        return {v: dist[v] for v in done}, pred

    def tree(self, source: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distance, predecessor: -1 for none) of all nodes, and those that are reached in the order of their distance. Predecessors are those of `dijkstra`; in arrays, so that a whole graph's tree stays small."""
        n = len(self.ids)
        dist, pred, done, order = array("d", [float("inf")]) * n, array("q", [-1]) * n, bytearray(n), array("q")
        dist[source], heap = 0.0, [(0.0, source)]
        begin = self.begin.tolist()
        while heap:
            d, v = heapq.heappop(heap)
            if done[v]:
                continue
            done[v] = 1
            order.append(v)
            a, b = begin[v], begin[v + 1]
            for w, x in zip(self.head[a:b].tolist(), self.weight[a:b].tolist(), strict=True):
                if not done[w] and d + x < dist[w]:
                    dist[w], pred[w] = d + x, v
                    heapq.heappush(heap, (d + x, w))
        return np.array(dist), np.array(pred), np.array(order, np.int64)

    @staticmethod
    def path(pred: dict[int, int], source: int, target: int) -> list[int]:
        out = [target]
        while out[-1] != source:
            out.append(pred[out[-1]])
        return out[::-1]


def to_csr(edges: DataFrame, weight: str = "len_m") -> Csr:
    """The graph on the driver, if it has no more than MAX_SENT_EDGES edges."""
    if (n := edges.count()) > MAX_SENT_EDGES:
        raise ValueError(f"{n} edges are too many to send to the tasks")
    t = edges.select("src", "dst", weight).toPandas()
    return Csr(t.src.to_numpy(np.int64), t.dst.to_numpy(np.int64), t[weight].to_numpy(float))


def _paths_by_rounds(pairs: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """As `shortest_paths`, by rounds of joins: labels (u, node, dist, pred) go one edge on each round from the nodes that changed, and not beyond a source's farthest target once it has labels for all."""
    goals = written(pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).distinct())
    ways = written(edges.groupBy(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("to")).agg(F.min(F.col(weight).cast("double")).alias("w")))
    on_graph = ways.select("node").unionAll(ways.select(F.col("to").alias("node"))).distinct()
    begin = goals.select("u", F.col("u").alias("node")).distinct().join(on_graph, "node", "left_semi")
    known = fresh = written(begin.select("u", "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")))
    while not fresh.isEmpty():
        bound = goals.join(known.select("u", F.col("node").alias("v"), "dist"), ["u", "v"], "left").groupBy("u").agg(F.when(F.count("dist") == F.count("*"), F.max("dist")).alias("most"))
        ahead = fresh.join(ways, "node").groupBy("u", F.col("to").alias("node")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("node").alias("pred"))).alias("m")).select("u", "node", "m.dist", "m.pred")
        better = ahead.join(known.select("u", "node", F.col("dist").alias("had")), ["u", "node"], "left").join(bound, "u").where("(had is null or dist < had) and (most is null or dist <= most)")
        fresh = written(better.select("u", "node", "dist", "pred"))
        known = written(known.join(fresh.select("u", "node"), ["u", "node"], "left_anti").unionAll(fresh))
    found = None
    back = written(goals.join(known.select("u", F.col("node").alias("v"), F.col("dist").alias("length")), ["u", "v"]).select("u", "v", "length", F.col("v").alias("node"), F.array("v").alias("path")))
    while not back.isEmpty():
        done = back.where("node = u").select("u", "v", "path", "length")
        found = done if found is None else found.unionAll(done)
        back = written(back.where("node <> u").join(known.select("u", "node", "pred"), ["u", "node"]).select("u", "v", "length", F.col("pred").alias("node"), F.concat(F.array("pred"), "path").alias("path")))
    return back.select("u", "v", "path", "length") if found is None else found


def shortest_paths(pairs: DataFrame, edges: DataFrame, weight: str = "len_m", csr: Csr | None = None, sent: int = MAX_SENT_EDGES) -> DataFrame:
    """pairs (u, v) to (u, v, path, length) for those that are connected, at every size of graph. Distinct pairs are searched once.

    Graphs of up to `sent` edges go to the tasks, over which the sources are dealt, those of one source in one search; larger ones
    are searched by rounds of joins. Lengths are the same; of equally short paths either way may give another.
    """
    spark = pairs.sparkSession
    if csr is None and edges.count() > sent:
        return _paths_by_rounds(pairs, edges, weight)
    graph = spark.sparkContext.broadcast(csr or to_csr(edges, weight))
    # a source's targets are split so that one source with most pairs does not make one task
    asked = pairs.select("u", "v").distinct().groupBy("u", F.pmod(F.xxhash64("v"), F.lit(16)).alias("part")).agg(F.collect_list("v").alias("vs"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for pdf in batches:
            rows = []
            for u, vs in zip(pdf.u, pdf.vs, strict=True):
                s = g.number(u)
                goal = {t: v for v in vs if (t := g.number(v)) >= 0}
                if s < 0 or not goal:
                    continue
                dist, pred = g.dijkstra(s, set(goal))
                rows += [(u, v, g.ids[g.path(pred, s, t)].tolist(), dist[t]) for t, v in goal.items() if t in dist]
            yield pd.DataFrame(rows, columns=["u", "v", "path", "length"])

    return asked.repartition(n, "u", "part").mapInPandas(search, "u long, v long, path array<long>, length double")


def tree_loads(loads: DataFrame, edges: DataFrame, weight: str = "len_m", sent: int = MAX_SENT_EDGES) -> DataFrame:
    """loads (u, v, n, s) to (src, dst, n, s): over the edges of the shortest paths from u to v, the sums of n and of s - n * ln(length). Loads of no length, of null ends or of ends that are not connected count nowhere.

    Paths of one source are a tree, and an edge's sum is that of the nodes below it: one search a source, and work that goes with the nodes and not with the paths' lengths. Graphs and paths are those of
    `shortest_paths`; beyond `sent` edges its paths are taken apart.
    """
    spark = loads.sparkSession
    one = loads.where("u is not null and v is not null").groupBy("u", "v").agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"))
    if edges.count() > sent:
        one = written(one)
        found = _paths_by_rounds(one, edges, weight).where("length > 0").join(one, ["u", "v"]).withColumn("s", F.col("s") - F.col("n") * F.ln("length"))
        m = F.greatest(F.lit(0), F.size("path") - 1)
        steps = F.zip_with(F.slice("path", 1, m), F.slice("path", 2, m), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
        return found.select(F.explode(steps).alias("e"), "n", "s").groupBy("e.src", "e.dst").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    graph = spark.sparkContext.broadcast(to_csr(edges, weight))
    asked = one.groupBy("u").agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n"), F.collect_list(F.coalesce("s", F.lit(0.0))).alias("s"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.value
        for pdf in batches:
            for u, vs, ns, ss in zip(pdf.u, pdf.v, pdf.n, pdf.s, strict=True):
                if (source := g.number(u)) < 0:
                    continue
                dist, pred, order = g.tree(source)
                at = np.searchsorted(g.ids, vs)
                at[at == len(g.ids)] = 0
                here = (g.ids[at] == vs) & (dist[at] > 0) & np.isfinite(dist[at])
                at, n, s = at[here], np.zeros(len(g.ids)), np.zeros(len(g.ids))
                n[at], s[at] = ns[here], ss[here] - ns[here] * np.log(dist[at])
                up, n, s = pred.tolist(), n.tolist(), s.tolist()
                for v in order[:0:-1].tolist():  # leaves first; the source has no edge
                    n[up[v]] += n[v]
                    s[up[v]] += s[v]
                v = order[1:][np.array(n)[order[1:]] > 0]
                yield pd.DataFrame({"src": g.ids[pred[v]], "dst": g.ids[v], "n": np.array(n)[v], "s": np.array(s)[v]})

    found = asked.repartition(parts, "u").mapInPandas(search, "src long, dst long, n double, s double")
    return found.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _spur_searches(classes: DataFrame, ways: DataFrame, floor: DataFrame, far: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The best path of each class (sid, u, v, root, at, banned, bound): from the root's last node to v, not over the root's nodes nor first to a banned one, as (sid, path, at); and (sid) of the classes that have none within the bound but may have one beyond.

    All classes in the same rounds: labels (sid, node) with the path so far and its cost at each node go one edge on. A label goes if with the least that is left (`floor`: v, node, left; for other nodes `far`) it is beyond the
    bound or the best path of its class. Of equal costs the path of the smaller ids stays.
    """
    known = fresh = written(classes.select("sid", F.element_at("root", -1).alias("node"), F.element_at("at", -1).alias("g"), F.col("root").alias("path"), "at"))
    rule = written(classes.join(far, "v", "left").select("sid", "v", "banned", "bound", F.size("root").alias("rooted"), F.coalesce("far", F.lit(0.0)).alias("far")))
    order = lambda g, path: F.struct(F.col(g).alias("g"), F.col(path).alias("path"))

    def onward(labels: DataFrame) -> DataFrame:
        steps = labels.join(rule, "sid").where("node <> v").join(ways, "node").where("not array_contains(path, to) and (size(path) > rooted or not array_contains(banned, to))")
        return steps.join(floor.withColumnRenamed("node", "to"), ["v", "to"], "left").withColumn("least", (F.col("g") + F.col("w") + F.coalesce("left", "far")) * (1 - 1e-9))

    while not fresh.isEmpty():
        best = known.join(rule.select("sid", F.col("v").alias("node")), ["sid", "node"]).select("sid", F.col("g").alias("best"))
        ahead = onward(fresh).join(best, "sid", "left").where("least <= bound and (best is null or least <= best)")
        ahead = ahead.select("sid", F.col("to").alias("node"), (F.col("g") + F.col("w")).alias("g"), F.concat("path", F.array("to")).alias("path"), F.concat("at", F.array(F.col("g") + F.col("w"))).alias("at"))
        ahead = ahead.groupBy("sid", "node").agg(F.min(F.struct("g", "path", "at")).alias("m")).select("sid", "node", "m.*")
        had = known.select("sid", "node", F.col("g").alias("g0"), F.col("path").alias("path0"))
        fresh = written(ahead.join(had, ["sid", "node"], "left").where(F.col("g0").isNull() | (order("g", "path") < order("g0", "path0"))).drop("g0", "path0"))
        known = written(known.join(fresh.select("sid", "node"), ["sid", "node"], "left_anti").unionAll(fresh))
    found = written(known.join(rule.select("sid", F.col("v").alias("node")), ["sid", "node"]).select("sid", "path", "at"))
    return found, onward(known.join(found, "sid", "left_anti")).where("least > bound").select("sid").distinct()


def _left(goals: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, node, left): the least cost from a node to v, up to v's farthest source; and (v, far): that cost, null if not all sources reach v. One search for all sources of a v."""
    known = fresh = written(goals.select("v", F.col("v").alias("node"), F.lit(0.0).alias("left")).distinct())
    into = ways.select(F.col("to").alias("node"), F.col("node").alias("from"), "w")
    while True:
        far = goals.join(known.select("v", F.col("node").alias("u"), "left"), ["u", "v"], "left").groupBy("v").agg(F.when(F.count("left") == F.count("*"), F.max("left")).alias("far"))
        if fresh.isEmpty():
            return known, far
        ahead = fresh.join(into, "node").groupBy("v", F.col("from").alias("node")).agg(F.min(F.col("left") + F.col("w")).alias("left"))
        ahead = ahead.join(known.withColumnRenamed("left", "had"), ["v", "node"], "left").join(far, "v").where("(had is null or left < had) and (far is null or left <= far)")
        fresh = written(ahead.select("v", "node", "left"))
        known = written(known.join(fresh.select("v", "node"), ["v", "node"], "left_anti").unionAll(fresh))


def simple_paths(pairs: DataFrame, edges: DataFrame, most: int, weight: str | None = None, within: float | None = None) -> DataFrame:
    """pairs (u, v), edges (src, dst, len_m, weight) to (u, v, path, length, hops, rank): the first `most` simple paths by hops (or by a weight), of equal ones those of the smaller ids, ranked by length from the longest.
    within: only paths of up to so many hops (or so much weight) are asked for; a pair may have fewer then.

    Deviations from the paths found (Yen's, each set of paths searched once): a path stands for the class of all that share its root and do not go first to a banned node. Expanded, it leaves a
    class for each of its later nodes. Each round expands, for all pairs at once, all paths among the first `most` - 1 that are not expanded; a class holds none before its own best, so with all of them expanded
    the first `most` are certain. While a pair has fewer than `most` paths, its classes are searched up to a limit of cost, twice that of its best path at first; those with nothing within wait, and are searched
    again, up to four times the limit, only if the pair has no other way to a path. So a class without any path is not searched over the whole graph. Nothing goes through the driver.

    Defined cases: a node on the graph has one path to itself, of length 0; no row for ends off the graph or not connected; equal pairs count once, null ends not at all; of parallel edges the best stays,
    loops and null weights are no edges; weights that are not positive raise.
    """
    if most < 1:
        raise ValueError("at least one path")
    with scratch() as keep:
        cost = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        clean = edges.select(F.col("src").cast("long").alias("node"), F.col("dst").cast("long").alias("to"), cost.alias("w"), F.col("len_m").cast("double").alias("len_m")).where("node <> to and w is not null")
        ways = written(clean.groupBy("node", "to").agg(F.min(F.struct("w", "len_m")).alias("m")).select("node", "to", "m.w", "m.len_m"))
        if not ways.where("w <= 0").isEmpty():
            raise ValueError("weights must be positive")
        steps = ways.drop("len_m")
        on_graph = ways.select(F.col("node").alias("u")).unionAll(ways.select("to")).distinct()
        goals = written(pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("v is not null").distinct().join(on_graph, "u", "left_semi"))
        floor, far = _left(goals, steps)
        far = written(far)
        # a class of its own for each pair: everything from u
        least = floor.select("v", F.col("node").alias("u"), "left")
        most_cost = F.lit(float("inf") if within is None else float(within))
        limits = written(goals.join(least, ["u", "v"]).where(F.col("left") <= most_cost).select("u", "v", "left", F.least(2 * F.col("left"), most_cost).alias("limit")))
        root = ["u", "v", "root", "at", "banned"]
        classes = limits.select("u", "v", F.array("u").alias("root"), F.array(F.lit(0.0)).alias("at"), F.slice(F.array("u"), 1, 0).alias("banned"), (F.col("left") * (1 + 1e-9)).alias("bound"))
        known = waiting = None
        while True:
            classes = written(classes.withColumn("sid", F.monotonically_increasing_id()))
            paths, cut = _spur_searches(classes, steps, floor, far)
            found = paths.join(classes.select("sid", "u", "v", "banned", F.size("root").alias("rooted")), "sid").select("u", "v", "path", "at", "banned", "rooted", F.lit(False).alias("done"))
            cut = classes.join(cut, "sid", "left_semi").select(root)
            waiting = written(cut if waiting is None else waiting.unionAll(cut))
            found = found.where(F.element_at("at", -1) <= most_cost)
            every = found if known is None else known.unionAll(found)
            place = F.row_number().over(W.partitionBy("u", "v").orderBy(F.element_at("at", -1), "path"))
            ranked = written(every.withColumn("place", place).where(F.col("place") <= most))
            open_ = (F.col("place") < most) & ~F.col("done") & (F.size("path") > F.col("rooted"))
            todo = ranked.where(open_)
            # pairs that lack paths and have nothing but what waits: their limit rises
            short = ranked.groupBy("u", "v").agg(F.count("*").alias("n"), F.max(open_).alias("busy")).where((F.col("n") < most) & ~F.col("busy"))
            short = written(short.join(waiting, ["u", "v"], "left_semi").join(limits.where(F.col("limit") < most_cost), ["u", "v"], "left_semi").select("u", "v"))
            raised = not short.isEmpty()
            if not raised and todo.isEmpty():
                break
            if raised:
                higher = limits.join(short.withColumn("more", F.lit(4.0)), ["u", "v"], "left")
                limits = written(higher.select("u", "v", "left", F.least(F.col("limit") * F.coalesce("more", F.lit(1.0)), most_cost).alias("limit")))
            bound = ranked.where(F.col("place") == most).select("u", "v", F.element_at("at", -1).alias("bound"))
            bound = limits.join(bound, ["u", "v"], "left").select("u", "v", F.coalesce("bound", "limit").alias("bound"))
            spurs = todo.select("*", F.explode(F.sequence(F.col("rooted"), F.size("path") - 1)).alias("i"))
            after = F.array(F.element_at("path", F.col("i") + 1))
            banned = F.when(F.col("i") == F.col("rooted"), F.array_union("banned", after)).otherwise(after)
            classes = spurs.select("u", "v", F.slice("path", 1, F.col("i")).alias("root"), F.slice("at", 1, F.col("i")).alias("at"), banned.alias("banned"))
            if raised:
                classes = classes.unionAll(waiting.join(short, ["u", "v"], "left_semi").select(root))
                waiting = waiting.join(short, ["u", "v"], "left_anti").select(root)
            classes = classes.join(bound, ["u", "v"])
            known = ranked.withColumn("done", F.col("done") | (F.col("place") < most)).drop("place")
        crossed = ranked.select("u", "v", "path", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("node"), F.slice("path", 2, F.size("path")).alias("to"))).alias("e"))
        lengths = crossed.select("u", "v", "path", "e.node", "e.to").join(ways, ["node", "to"]).groupBy("u", "v", "path").agg(F.sum("len_m").alias("length"))
        out = ranked.join(lengths, ["u", "v", "path"], "left").select("u", "v", "path", F.coalesce("length", F.lit(0.0)).alias("length"), (F.size("path") - 1).alias("hops"))
        return keep(out.withColumn("rank", F.row_number().over(W.partitionBy("u", "v").orderBy(F.desc("length"), "path"))))


def line_graph(edges: DataFrame, nodes: DataFrame, turn_deg: float = 30.0) -> DataFrame:
    """Turns of over turn_deg as edges between edges: (src, mid, dst, angle, penalty_s)."""
    a = edges.select("src", F.col("dst").alias("mid"))
    b = edges.select(F.col("src").alias("mid"), "dst")
    pos = lambda k: nodes.select(F.col("id").alias(k), F.struct("lat", "lon").alias(f"p_{k}"))
    turns = a.join(b, "mid").where("src <> dst").join(pos("src"), "src").join(pos("mid"), "mid").join(pos("dst"), "dst")
    angle = geo.turn_angle(F.col("p_src"), F.col("p_mid"), F.col("p_dst"))
    return turns.withColumn("angle", angle).where(F.abs("angle") >= turn_deg).select("src", "mid", "dst", "angle", turn_penalty(F.col("angle")).alias("penalty_s"))


def turn_penalty(angle: Column) -> Column:
    a = F.abs(angle)
    return F.when(a >= 150, F.lit(120.0)).otherwise(30 * a / 90)


def retrace(tree: DataFrame, leaf: int) -> DataFrame:
    """tree (node, pred) to (step, node) from the leaf back to the root, by a recursive query."""
    tree.select(F.col("node").cast("long").alias("node"), F.col("pred").cast("long").alias("pred")).createOrReplaceTempView("_retrace")
    return tree.sparkSession.sql(f"""
        WITH RECURSIVE way(step, node) AS (
          SELECT 0, CAST({int(leaf)} AS BIGINT) UNION ALL SELECT step + 1, t.pred FROM way JOIN _retrace t ON t.node = way.node WHERE t.pred IS NOT NULL
        ) SELECT step, node FROM way""")


def concat_route(pieces: DataFrame) -> DataFrame:
    """pieces (route, pos, node_ids) to (route, node_ids): the pieces in order, each turned so that it goes on from the one before; a gap raises."""

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ways = [list(w) for w in pdf.sort_values("pos").node_ids]
        out = ways[0]
        if len(ways) > 1 and out[-1] not in (ways[1][0], ways[1][-1]):
            out = out[::-1]
        for w in ways[1:]:
            if w[0] != out[-1]:
                w = w[::-1]
            if w[0] != out[-1]:
                raise ValueError(f"route {key[0]} has a gap")
            out = out + w[1:]
        return pd.DataFrame({"route": [key[0]], "node_ids": [out]})

    return pieces.groupBy("route").applyInPandas(join, "route string, node_ids array<long>")
