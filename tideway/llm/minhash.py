"""Near-duplicate detection by MinHash with tensored banding, and exact verification.

A document's set is its distinct k-word shingles. Two small collections of m sub-keys, each of R
minimum hashes, are made for a set. Every pair of one sub-key from either collection is a table key:
2 * m * R minimum hashes serve m * m tables of 2 * R hashes each. Sets of similarity s share a key with
probability (1 - (1 - s**R)**m)**2; `sub_keys` picks m so that it misses less than MISS at the threshold.

1. Documents with equal sets form a class; only one of each class goes on.
2. Classes that share a table key are candidates. In rounds, each key names one class as its centre, and
   each class of another component is tried against one centre, the one it shares most keys with. What
   is linked becomes one component, and only keys that still hold several components go into the next
   round: a round tries at most one pair for each class, whatever the size of a group.
3. A pair is verified on its full sets: members are dealt to their centre, stars of many members over
   several tasks.
4. After the rounds no link may be lost between the components that still meet in a key. Where a key has
   two classes, they are tried. Of the other keys' classes: of the shingles
   that at most RARE of their classes have, two alike classes that share any share one among the rarest
   few of each (prefix filter): such pairs are tried. Classes that share none have at most their other
   shingles in common; only where that bound and the sizes allow the threshold, and enough sub-keys are
   equal, is the pair tried too. A pair is named once, at the first sub-key that both have.
5. Each class has a sketch of BITS bits, each the parity of how many of its shingles fall there. The bits in
   which two sketches differ are at most the shingles that only one of the two has, so a pair with more of
   them than the threshold allows is no link for certain, and is never dealt to a task.

Small tables are broadcast and the rest shuffled (BROADCAST_ROWS); this and STAR only deal out work.
RARE and ROUNDS move pairs between steps 2 and 4; what is linked does not depend on them.

Defined cases: null and blank texts have empty sets, link with nothing and form components of
themselves; fewer than k words make one shingle; rows with equal sets are always linked, whatever
their ids; the component of rows without any non-null id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .frames import scratch, small_batches, stored, text_key
from .words import Words, mix, slices

#: Minimum hashes of a sub-key, two of which make a table key.
R = 2
#: Accepted chance of missing a pair at the threshold itself.
MISS = 1e-4
#: Rounds of stars before what is left is tried pair by pair.
ROUNDS = 3
#: Bits of the parity sketch of a set; more tell larger sets apart, fewer lose no link.
BITS = 1024
#: Classes that may have a shingle that counts as rare.
RARE = 40
#: Members of a star that one task compares.
STAR = 512
#: Rows of (id, key, centres) up to which they are broadcast to the texts; above, both sides are shuffled.
BROADCAST_ROWS = 50_000


def sub_keys(threshold: float, miss: float = MISS) -> int:
    """m, so that a pair at the threshold shares a table key with probability over 1 - miss."""
    return math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - threshold**R))


def least_matches(threshold: float, m: int) -> int:
    """Equal sub-keys, of 2 * m, that a pair at the threshold has but for one in a million."""
    q, n = threshold**R, 2 * m
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * q**k * (1 - q) ** (n - k)
        if total > 1e-6:
            return k
    return n


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin and end."""
    counts = np.diff(w.first)
    have = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(have)), have)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(w.first[:-1], have)
    values = w.sequence_hash(start, np.minimum(start + k, w.first[1:][doc]))
    bounds = np.concatenate([[0], np.cumsum(have)])
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)])


def parity_sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set of hashes, BITS // 64 words of bits: whether an odd number of its hashes fall there."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bit = (mix(values ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(20)).astype(np.int64) % BITS
    odd = np.bincount(row * BITS + bit, minlength=(len(bounds) - 1) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(k: int, m: int):
    rng = np.random.default_rng(509)
    xor = rng.integers(0, 1 << 63, 2 * m * R, dtype=np.uint64)
    odd = rng.integers(0, 1 << 62, 2 * m * R, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            for a, b, data, offsets in slices(texts):
                values, bounds = shingle_sets(Words(data, offsets, lower=True), k)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                out = np.zeros((b - a, 2 * m), np.uint64)
                names = np.zeros((2, b - a), np.uint64)
                if len(full):
                    at = bounds[:-1][full]
                    lows = [np.minimum.reduceat((values ^ x) * o, at) for x, o in zip(xor, odd, strict=True)]
                    for j in range(2 * m):
                        key = np.full(len(full), j, np.uint64)
                        for low in lows[j * R : (j + 1) * R]:
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ low)
                        out[full, j] = key
                    names[0, full] = mix(np.add.reduceat(mix(values), at) + sizes[full].astype(np.uint64))
                    names[1, full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                flat = pa.array(out.reshape(-1).view(np.int64))
                parts = pa.FixedSizeListArray.from_arrays(flat, 2 * m).cast(pa.list_(pa.int64()))
                parity = pa.FixedSizeListArray.from_arrays(pa.array(parity_sketches(values, bounds)), BITS // 64).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), keys.slice(a, b - a), pa.array(sizes), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), parts, parity], names=["id", "k", "n", "c", "c2", "subs", "odd"])

    return run


def _compare(k: int, percent: int):
    """Texts by star, the centre first, to the links of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            centres, salts, members, texts = (batch.column(i) for i in range(4))
            links: list[tuple[int, int]] = []
            for a, _, data, offsets in slices(texts):
                values, bounds = shingle_sets(Words(data, offsets, lower=True), k)
                for i in range(len(offsets) - 1):
                    mine = values[bounds[i] : bounds[i + 1]]
                    c, s, x = centres[a + i].as_py(), salts[a + i].as_py(), members[a + i].as_py()
                    if x is None:
                        star, centre = (c, s), mine
                        continue
                    assert star == (c, s), "a member came before its centre"
                    lo, hi = sorted((len(mine), len(centre)))
                    if 100 * lo < percent * hi:
                        continue
                    found = np.searchsorted(centre, mine)
                    found[found == len(centre)] = 0
                    common = int((centre[found] == mine).sum())
                    if 100 * common >= percent * (lo + hi - common):
                        links.append((x, c))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([c for _, c in links], pa.int64())], names=["a", "b"])

    return run


def _verified(stars: DataFrame, texts: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """stars (centre, member), each pair once, to the links (a, b) among them."""
    spark = texts.sparkSession
    # stored, so that the join below is of two plain exchanges and a star of many members can be split over tasks
    stars = stored(stars)
    sizes = stored(stars.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts")))
    members = stars.join(sizes, "centre").select(F.col("member").alias("v"), "centre", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("salt"), "member")
    centres = sizes.select(F.col("centre").alias("v"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"))
    wanted = members.unionAll(centres).join(classes.select(F.col("c").alias("v"), "id", "k"), "v")
    lists = stored(wanted.groupBy("id", "k").agg(F.collect_list(F.struct("centre", "salt", "member")).alias("roles")))
    if lists.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    t, w = texts.alias("t"), lists.alias("w")
    dealt = t.join(w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.k") == F.col("w.k"))).select("t.id", "t.k", "t.text", "w.roles")
    dealt = dealt.select("text", F.explode("roles").alias("r")).select("r.centre", "r.salt", "r.member", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())
    return sorted_.mapInArrow(_compare(k, percent), "a long, b long")


def _as_stars(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, to (centre, member): the end with more pairs is the centre."""
    degrees = stored(pairs.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d")))
    one, two = degrees.select(F.col("v").alias("a"), F.col("d").alias("da")), degrees.select(F.col("v").alias("b"), F.col("d").alias("db"))
    first = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return pairs.join(one, "a").join(two, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"))


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b, data, offsets in slices(texts):
                values, bounds = shingle_sets(Words(data, offsets, lower=True), k)
                row = np.repeat(np.arange(a, b), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(values.view(np.int64))], names=["c", "token"])

    return run


def _rare(members: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """members (c, id, k, n) to (c, own): how many shingles of c at most RARE members have, and (a, b): all pairs that may be alike and share one of those. No shingle gives more than RARE * (RARE - 1) / 2 pairs."""
    sizes = members.select("c", "n")
    members = members.drop("n")
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    t, w = texts.alias("t"), members.alias("w")
    held = t.join(w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.k") == F.col("w.k"))).select("w.c", "t.text").dropDuplicates(["c"])
    tokens = held.mapInArrow(_tokens(k), "c long, token long")
    few = tokens.groupBy("token").agg(F.count("*").alias("often")).where(F.col("often") <= RARE)
    rare = tokens.join(few, "token").join(sizes, "c")
    place = F.row_number().over(W.partitionBy("c").orderBy("often", "token"))
    # of a class that is alike to another, so many shingles at most are not in the other: one of the rarest so many and one is, if any rare one is
    rare = stored(rare.withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).select("c", "token", "often"))
    own = tokens.join(few, "token").groupBy("c").agg(F.count("*").alias("own"))
    cs = rare.where("often > 1").groupBy("token").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return own, cs.select(F.explode(_all_pairs("cs")).alias("p")).select("p.a", "p.b").distinct()


def _all_pairs(array: str) -> Column:
    return F.flatten(F.transform(array, lambda x: F.transform(F.filter(array, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def _plausible(pairs: DataFrame, light: DataFrame, percent: int, need: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose sizes, sketches and sub-keys allow the threshold."""
    x, y = light.toDF("a", "na", "sa", "oa"), light.toDF("b", "nb", "sb", "ob")
    sized = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return pairs.join(x, "a").join(y, "b").where(sized & _near("oa", "ob", F.col("na") + F.col("nb"), percent) & (_equal("sa", "sb") >= need)).select("a", "b")


def _near(x: str, y: str, sizes: Column, percent: int) -> Column:
    """Whether two sketches differ in few enough bits: of two sets with d shingles that only one has, 100 * (sizes - d) >= percent * (sizes + d)."""
    apart = reduce(Column.__add__, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)])
    return F.lit(100 + percent) * apart <= F.lit(100 - percent) * sizes


def _round(cells: DataFrame, comps: DataFrame | None, turn: int) -> tuple[DataFrame, DataFrame]:
    """cells (key, c, common) to those whose keys hold several components, and one pair (a, b) for each of their classes that does not belong to the component of one of its centres."""
    now = cells.withColumn("component", F.col("c"))
    if comps is not None:
        now = cells.join(comps.select(F.col("v").alias("c"), "component"), "c", "left").select("key", "c", "common", F.coalesce("component", "c").alias("component"))
    order = F.col("common") if turn == 0 else F.xxhash64("c", F.lit(turn))
    tops = now.groupBy("key").agg(F.max(F.struct(order.alias("order"), "c", "component")).alias("top"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    tops = stored(tops.select("key", F.col("top.c").alias("centre"), F.col("top.component").alias("of")))
    open_ = stored(now.join(tops, "key"))
    shares = open_.where("component <> of").groupBy("c", "centre").agg(F.count("*").alias("shares"))
    best = shares.groupBy("c").agg(F.max_by("centre", F.struct("shares", "centre")).alias("centre"))
    return open_.select("key", "c", "common"), best.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, k (tells rows of one id apart), n_shingles, component_id (smallest id reachable by links of 100 * intersection >= percent * union), component (a number of the component, null for an empty set)."""
    with scratch() as keep:
        return _near_duplicates(docs, percent, shingle, id_col, text_col, keep)


def _near_duplicates(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, keep) -> DataFrame:
    small_batches(docs.sparkSession)
    threshold = percent / 100
    m = sub_keys(threshold)
    need = least_matches(threshold, m)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_key(text_col), F.lit(0)).alias("k"), F.col(text_col).alias("text"))
    signed = keep(source.mapInArrow(_signatures(shingle, m), "id long, k long, n long, c long, c2 long, subs array<bigint>, odd array<bigint>"))
    classes = stored(signed.where("n > 0").groupBy("c", "c2").agg(F.min(F.struct("id", "k")).alias("r"), F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("subs").alias("subs"), F.first("odd").alias("odd")).select("c", "c2", "r.id", "r.k", "least_id", "n", "subs", "odd"))
    single = classes.select("c", F.posexplode("subs").alias("place", "sub"))
    common = stored(single.groupBy("place", "sub").agg(F.count("*").alias("often")).where("often > 1"))
    central = single.join(common, ["place", "sub"]).groupBy("c").agg(F.sum("often").alias("common"))
    pair_keys = F.flatten(F.transform(F.slice("subs", 1, m), lambda x: F.transform(F.slice("subs", m + 1, m), lambda y: F.xxhash64(x, y))))
    keyed = stored(classes.join(central, "c").select("c", "common", F.explode(pair_keys).alias("key")))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"))
    cells, light = keyed.join(shared, "key"), classes.select("c", "n", "subs", "odd")
    tried, links, comps = None, None, None
    for turn in range(ROUNDS):
        cells, pairs = _round(cells, comps, turn)
        pairs = _plausible(pairs, light, percent, need)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionAll(pairs)
        # the pair's end that is the centre of several keys draws the stars together
        more = stored(_verified(_as_stars(pairs), source, classes, shingle, percent))
        links = more if links is None else links.unionAll(more)
        comps = connected_components(links)
    links_left = _left(cells, comps, tried, source, classes, light, shingle, percent, m, need)
    if links_left is not None:
        comps = connected_components(links_left if links is None else links.unionAll(links_left))
    if comps is None:
        ids = classes.select("c", "c2", F.col("least_id").alias("component_id"), F.col("c").alias("component"))
    else:
        of = classes.select("c", "c2", "least_id").join(comps.select(F.col("v").alias("c"), "component"), "c", "left").select("c", "c2", "least_id", F.coalesce("component", "c").alias("component"))
        of = stored(of)
        least = stored(of.groupBy("component").agg(F.min("least_id").alias("component_id")))
        ids = of.join(least, "component").select("c", "c2", "component_id", "component")
    ids = keep(ids)
    full = signed.where("n > 0").join(ids, ["c", "c2"]).select("id", "k", F.col("n").alias("n_shingles"), "component_id", "component")
    blank = signed.where("n = 0").select("id", "k", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.unionAll(blank)


def _left(cells: DataFrame, comps: DataFrame | None, tried: DataFrame | None, source: DataFrame, classes: DataFrame, light: DataFrame, shingle: int, percent: int, m: int, need: int) -> DataFrame | None:
    """The links that the rounds have not tried, between components that meet in a key; None if there can be none."""
    component = F.coalesce("component", "c").alias("component")
    names = classes.select(F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("component")).limit(0) if comps is None else comps.select("v", "component")
    of = names.toDF("c", "component")
    left = cells.join(of, "c", "left").select("key", "c", component)
    mixed = left.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("c").alias("a"), F.max("c").alias("b")).where("x <> y")
    mixed = stored(mixed.select("key", "size", "a", "b"))
    # a key of two classes says the pair itself
    of_two = _plausible(mixed.where("size = 2").select("a", "b").distinct(), light, percent, need)
    open_ = stored(left.join(mixed.where("size > 2").select("key"), "key").select("c").distinct())
    again = of_two if open_.isEmpty() else of_two.unionAll(_of_larger_keys(open_, of, source, classes, light, shingle, percent, m, need)).distinct()
    again = stored(again if tried is None else again.join(tried, ["a", "b"], "left_anti"))
    return None if again.isEmpty() else stored(_verified(_as_stars(again), source, classes, shingle, percent))


def _of_larger_keys(open_: DataFrame, of: DataFrame, source: DataFrame, classes: DataFrame, light: DataFrame, shingle: int, percent: int, m: int, need: int) -> DataFrame:
    """Pairs (a, b) of the classes open_ in different components (of: c, component) that may be alike, by their rare shingles or the bound without those."""
    component = F.coalesce("component", "c").alias("component")
    own, common = _rare(open_.join(classes, "c").select("c", "id", "k", "n"), source, shingle, percent)
    bound = open_.join(light, "c").join(own, "c", "left").select("c", "n", "subs", "odd", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most"))
    able = stored(bound.where(f"100 * most >= {percent} * n").join(of, "c", "left").withColumn("component", component))
    each = stored(able.select("c", "n", "most", "component", "subs", "odd", F.posexplode(F.slice("subs", 1, m)).alias("place", "sub")))
    # classes that share a table key share a sub-key of the first collection, and those are fewer
    meet = F.least("l.most", "r.most")
    sizes = F.col("l.n") + F.col("r.n")
    fits = (F.lit(100) * meet >= F.lit(percent) * (sizes - meet)) & _near("l.odd", "r.odd", sizes, percent)
    alike = (_equal("l.subs", "r.subs") >= need) & (_first_equal("l.subs", "r.subs") == F.col("l.place"))
    met = each.alias("l").join(each.alias("r"), (F.col("l.place") == F.col("r.place")) & (F.col("l.sub") == F.col("r.sub")) & (F.col("l.component") < F.col("r.component")) & fits & alike).select(F.least("l.c", "r.c").alias("a"), F.greatest("l.c", "r.c").alias("b"))
    apart = common.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return met.unionAll(_plausible(apart, light, percent, need))


def _equal(x: str, y: str) -> Column:
    return F.size(F.filter(F.arrays_zip(F.col(x).alias("u"), F.col(y).alias("v")), lambda p: p["u"] == p["v"]))


def _first_equal(x: str, y: str) -> Column:
    """The first place at which both arrays have the same."""
    return F.array_position(F.transform(F.arrays_zip(F.col(x).alias("u"), F.col(y).alias("v")), lambda p: p["u"] == p["v"]), True) - 1


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less all but one of each component: the row of the smallest id stays (null ids come last). Rows with empty sets stay."""
    found = stored(near_duplicates(docs, percent, shingle, id_col, text_col).select("id", "k", "component"))
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k")).alias("r"))
    one, blank = first.select("r.id", "r.k"), found.where("component is null").select("id", "k").distinct()
    key = "_k"
    while key in docs.columns:
        key += "_"
    named = docs.withColumn(key, F.coalesce(text_key(text_col), F.lit(0)))
    among = lambda rows: named.alias("d").join(rows.alias("s"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("s.id")) & (F.col(f"d.{key}") == F.col("s.k")), "left_semi")
    twice = found.where("component is not null").groupBy("id", "k").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        kept = among(one.unionAll(blank))
    else:  # the same row more than once: one stays, but all of the blank ones
        kept = among(one).dropDuplicates([id_col, key]).unionAll(among(blank))
    return kept.drop(key)
