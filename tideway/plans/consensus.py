"""The consensus route of many matched paths: candidates from what usually comes next, scored against the sources."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..frames import scratch, written
from ..functions import geo
from ..functions.text import sequence_ratio
from ..operators.ordered import remove_repeats_array

MIN_SOURCES, MIN_WAYPOINTS, ROUNDS, REPEATS, MOST, LEAST = 12, 4, 30, 20, 48, 12
REFINE_M, NEAR_M = 5.0, 10.0


def clean_path(path: Column, geo_path: Column) -> Column:
    """struct<path, geo_path> without consecutive equal coordinates, the two kept aligned."""
    both = F.zip_with(path, geo_path, lambda n, p: F.struct(n.alias("n"), p.alias("p")))
    kept = F.filter(both, lambda x, i: (i == 0) | ~x["p"].eqNullSafe(F.get(both, i - 1)["p"]))
    return F.struct(F.transform(kept, lambda x: x["n"]).alias("path"), F.transform(kept, lambda x: x["p"]).alias("geo_path"))


def qualified(sources: DataFrame, key: list[str], waypoints: str = "waypoints_used", least_sources: int = MIN_SOURCES) -> DataFrame:
    """Sources of enough waypoints, of routes with enough such sources."""
    some = sources.where(F.size(waypoints) >= MIN_WAYPOINTS)
    return some.join(some.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_sources).drop("_n"), key, "left_semi")


def next_counts(paths: DataFrame, path: str = "path") -> DataFrame:
    """(p0, p1, p2, n): how often each directed edge goes on to each point."""
    clean = remove_repeats_array(F.col(path))
    i = F.when(F.size("_c") >= 3, F.sequence(F.lit(0), F.size("_c") - 3)).otherwise(F.array().cast("array<int>"))
    triples = paths.select(clean.alias("_c")).select("_c", F.explode(i).alias("i"))
    return triples.groupBy(F.get("_c", F.col("i")).alias("p0"), F.get("_c", F.col("i") + 1).alias("p1"), F.get("_c", F.col("i") + 2).alias("p2")).agg(F.count("*").alias("n"))


def _follow(a, b, after: dict, most: int) -> list:
    """On from edge (a, b) to the commonest next point; a count is halved when used, so a loop is left."""
    counts, out = {k: dict(v) for k, v in after.items()}, [a, b]
    while len(out) < most and (options := counts.get((out[-2], out[-1]))):
        nxt = max(sorted(options), key=options.get)
        if options[nxt] < 1:
            break
        options[nxt] /= 2
        out.append(nxt)
    return out


def candidates_of(paths: list[list], rounds: int = ROUNDS, repeats: int = REPEATS, seed: int = 0) -> Counter:
    """Candidate routes with their frequency: from an edge, drawn by a hash of round and repeat, both ways to the ends."""
    if len(paths) < 2:
        return Counter(tuple(p) for p in paths)
    forward, backward, edges = defaultdict(Counter), defaultdict(Counter), Counter()
    for p in paths:
        edges.update(zip(p, p[1:], strict=False))
        for a, b, c in zip(p, p[1:], p[2:], strict=False):
            forward[a, b][c] += 1
            backward[c, b][a] += 1
    roots = sorted(edges)
    if not roots:
        return Counter(tuple(p) for p in paths)
    weight = np.cumsum([edges[e] for e in roots])
    longest = 2 * max(map(len, paths))
    found: Counter = Counter()
    for k in range(rounds * repeats):
        u = int.from_bytes(hashlib.blake2b(f"{seed}/{k}".encode(), digest_size=6).digest(), "big") / 2**48
        a, b = roots[int(np.searchsorted(weight, u * weight[-1], "right"))]
        found[tuple(_follow(b, a, backward, longest)[::-1][:-2] + _follow(a, b, forward, longest))] += 1
    top = found.most_common(MOST)
    cut = top[min(len(top), 10) - 1][1]  # the tenth largest; ties stay
    return Counter({p: n for p, n in top if n >= cut or len(top) <= LEAST})


def candidates(sources: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """sources (key, path) to (key, cand, path, share)."""

    def one(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = candidates_of([list(p) for p in pdf.sort_values("path", key=lambda s: s.map(tuple)).path], seed=seed)
        total = sum(found.values())
        rows = [(k[0], i, list(p), n / total) for i, (p, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], x[0])))]
        return pd.DataFrame(rows, columns=[key, "cand", "path", "share"])

    kind = dict(sources.dtypes)[key]
    return sources.select(key, "path").groupBy(key).applyInPandas(one, f"{key} {kind}, cand int, path array<long>, share double")


def fitness(covr: Column, miss: Column, dist: Column, turn: Column) -> Column:
    """Lower is better."""
    return covr + miss + F.sqrt(dist) + F.coalesce(F.try_divide(turn, dist), F.lit(0.0))


def score(cands: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """cands (key, cand, geo_path), sources (key, geo_path) to (key, cand, covr, miss, dist, turn, score, rank): over routes refined to 5 m, how far source points are from the candidate and its points from the sources, its length (km) and its turns."""
    own = cands.select(key, "cand", geo.refine(F.col("geo_path"), REFINE_M).alias("pts"), (geo.path_length(F.col("geo_path")) / 1000).alias("dist"), geo.total_turn(F.col("geo_path")).alias("turn"))
    cloud = sources.select(key, F.explode(F.col("geo_path")).alias("s")).distinct().groupBy(key).agg(F.collect_list("s").alias("cloud"))  # distinct points of one route

    def metrics(batches):
        def sphere(a, b):
            (la, oa), (lb, ob) = np.radians(a).T, np.radians(b).T
            h = np.sin((lb[None] - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb)[None] * np.sin((ob[None] - oa[:, None]) / 2) ** 2
            return 2 * geo.SPHERE_M * np.arcsin(np.minimum(1, np.sqrt(h)))

        def closest(a, b):
            return np.concatenate([sphere(a[i : i + 256], b).min(1) for i in range(0, len(a), 256)])

        for pdf in batches:
            covr, miss = [], []
            for pts, cloud in zip(pdf.pts, pdf.cloud, strict=True):
                p, c = (np.array([[x["lat"], x["lon"]] for x in v]) for v in (pts, cloud))
                covr.append(float(closest(c, p).mean()))
                miss.append(float(closest(p, c).mean()))
            yield pdf.drop(columns=["pts", "cloud"]).assign(covr=covr, miss=miss)

    kind = dict(own.dtypes)[key]
    joined = own.join(cloud, key).select(key, "cand", "dist", "turn", "pts", "cloud")
    found = joined.mapInPandas(metrics, f"{key} {kind}, cand int, dist double, turn double, covr double, miss double")
    scored = found.withColumn("score", fitness(F.col("covr"), F.col("miss"), F.col("dist"), F.col("turn")))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("score", "cand")))


def consensus(cands: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """The best candidate of each route."""
    return cands.join(scored.where("rank = 1").select(key, "cand", "score"), [key, "cand"])


def linkage(pairs: DataFrame, key: str) -> DataFrame:
    """pairs (key, a, b, dist) of all a < b of each key to the merges of complete linkage: (key, lo, hi, dist, round), where clusters go by their smallest member and hi is merged into lo.

    In each round all pairs of clusters that are nearest to each other merge, of all keys at once. With complete linkage no later merge comes nearer, so that
    the merges in order of distance are those of merging one nearest pair after the other (of equal distances, either may come first).
    """
    merges: list[DataFrame] = []
    d = written(pairs.select(key, "a", "b", "dist"))
    while not d.isEmpty():
        both = d.select(key, "a", F.struct("dist", F.col("a").alias("lo"), F.col("b").alias("hi")).alias("m")).unionAll(d.select(key, "b", F.struct("dist", F.col("a").alias("lo"), F.col("b").alias("hi")).alias("m")))
        nearest = both.groupBy(key, "a").agg(F.min("m").alias("m"))
        mutual = written(nearest.groupBy(key, "m").agg(F.count("*").alias("n")).where("n = 2").select(key, "m.lo", "m.hi", "m.dist"))
        merges.append(mutual.withColumn("round", F.lit(len(merges))))
        for side in "ab":
            new = mutual.select(key, F.col("hi").alias(side), F.col("lo").alias("_lo"))
            d = d.join(new, [key, side], "left").withColumn(side, F.coalesce("_lo", side)).drop("_lo")
        d = written(d.where("a <> b").groupBy(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("dist").alias("dist")))
    if not merges:
        return d.select(key, F.col("a").alias("lo"), F.col("b").alias("hi"), "dist", F.lit(0).alias("round"))
    return reduce(DataFrame.unionAll, merges)


def main_cluster(sources: DataFrame, key: str, keep: float = 0.75) -> DataFrame:
    """Complete-linkage clustering of each key's paths by sequence similarity, into a quarter as many clusters as sources; the rows of the largest stay (of equal ones, that of the first row).

    All pairs within a key are compared, so keys should have few sources, as `qualified` leaves them. Two paths are as far apart as the less
    similar of both ways to compare them. Rows with a null key or path are left out.
    """
    w = W.partitionBy(key)
    with scratch() as hold:
        rows = sources.where(F.col(key).isNotNull() & F.col("path").isNotNull())
        rows = written(rows.withColumn("_id", F.row_number().over(w.orderBy(F.to_json(F.struct(*sources.columns))))).withColumn("_n", F.count("*").over(w)))
        side = lambda i: rows.select(key, F.col("_id").alias(i), F.col("path").alias(f"p{i}"))
        pairs = side("a").join(side("b"), key).where("a < b").withColumn("dist", 1 - F.least(sequence_ratio("pa", "pb"), sequence_ratio("pb", "pa")))
        merges = linkage(pairs, key)
        wanted = rows.select(key, "_n").distinct()
        order = F.row_number().over(w.orderBy("dist", "round", "lo", "hi"))
        made = merges.withColumn("_at", order).join(wanted, key).where(F.col("_at") <= F.col("_n") - F.greatest(F.lit(1), F.bround((1 - keep) * F.col("_n"))))
        up = rows.select(key, "_id").join(made.select(key, F.col("hi").alias("_id"), "lo"), [key, "_id"], "left").select(key, "_id", F.coalesce("lo", "_id").alias("top"))
        while True:  # twice as far up in each round
            up = written(up)
            ahead = up.select(key, F.col("_id").alias("top"), F.col("top").alias("_up"))
            moved = up.join(ahead, [key, "top"])
            if moved.where("_up <> top").isEmpty():
                break
            up = moved.select(key, "_id", F.col("_up").alias("top"))
        size = up.groupBy(key, "top").agg(F.count("*").alias("n"))
        best = size.groupBy(key).agg(F.max_by("top", F.struct("n", -F.col("top"))).alias("top"))
        return hold(rows.join(up.join(best, [key, "top"]).select(key, "_id"), [key, "_id"]).select(*sources.columns))
