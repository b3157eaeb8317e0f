"""Benchmark passages in documents: a prefix-filtered set join, in DataFrame operations only.

An item is a set of windows of `window` words (an item of fewer is one window), a window a sequence of
shingles of five words. A document contains a window only if it contains the window's rarest shingle,
so that one shingle is the whole prefix to join on:

1. Occurrences of benchmark shingles in the documents, each with the words around it, are found in one
   pass for all shingle sizes and stored; what is found is named by the document's id and the hash of its
   text, so equal rows share it.
2. Shingles are ordered by their number of occurrences in all documents (ties by hash). A window's
   prefix is its rarest shingle, with its place in the window.
3. An occurrence of a prefix is a candidate for the windows that start there. It must leave room for the
   window on either side (positional and length bounds), and the window's words must equal the
   document's, word for word.

The shingles of the benchmark are broadcast to the texts while they are at most BROADCAST_ROWS, and one row
a document for its number of words comes in the same pass. Above that Spark joins by a shuffle, in which a
place is four numbers and the document's id: no words and no kept columns. What it finds is gathered by
document, at most once for each of its places, and meets the text again for the words around; the numbers
of words have a branch of their own, without a join. Nothing else is broadcast by hint.

Defined cases: null has no words; a document without words is clean; an item without words occurs
nowhere; items with equal ids count once and null ids never; each row of docs is judged by itself, also
if rows or ids repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

BROADCAST_ROWS = 1_000_000
SHINGLE = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does that where no letter beyond ASCII could change."""
    return F.when(text.rlike(r"[^\x00-\x7Fß-öø-ÿ]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashes(words: Column, size: int) -> Column:
    """The hash of each run of `size` words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))


def benchmark_windows(items: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows: words, size, items (ids as strings)."""
    texts = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    each = texts.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items")).select("words", F.size("words").alias("size"), "items")


def _places(source: DataFrame, sizes: list[int]) -> DataFrame:
    """id, k, s, p (from 1), h of each shingle, and nothing else of the document."""
    of_size = lambda s: F.transform(_hashes(F.col("w"), s), lambda h, i: F.struct(F.lit(s).alias("s"), (i + 1).alias("p"), h.alias("h")))
    every = F.concat(*map(of_size, sizes))
    # exploded as an expression: of a column Spark would infer a filter on its size and push it, with the words' expression in every lambda, below the words
    return source.select("id", "k", F.explode(every).alias("e")).select("id", "k", "e.*")


def _found_by_shuffle(source: DataFrame, marked: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """Occurrences of the marked shingles (h, s): id, k, n, p, h, around, s, reach."""
    hits = _places(source, sizes).join(marked, ["s", "h"], "left_semi")
    gathered = stored(hits.groupBy("id", "k").agg(F.collect_set(F.struct("s", "p", "h")).alias("hits"))).alias("g")
    texts = source.select("id", "k", "w").alias("d").join(gathered, F.col("d.id").eqNullSafe(F.col("g.id")) & (F.col("d.k") == F.col("g.k")))
    reach = lambda x: F.lit(window) - x["s"]
    around = F.transform("g.hits", lambda x: x.withField("around", F.slice("d.w", F.greatest(F.lit(1), x["p"] - reach(x)), reach(x) * 2 + x["s"])).withField("reach", reach(x)))
    return texts.select("d.id", "d.k", F.size("d.w").alias("n"), F.explode(around).alias("x")).select("id", "k", "n", "x.p", "x.h", "x.around", "x.s", "x.reach")


def _found_by_broadcast(source: DataFrame, marked: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """As `_found_by_shuffle`, and a row of p = 0 with `kept` for each document."""
    marked = F.broadcast(marked.unionAll(marked.sparkSession.range(1).select(F.lit(-1).cast("long").alias("h"), F.lit(0).alias("s"))))  # at most BROADCAST_ROWS and one
    # place 0 is a mark, so that every document gets a row; then come the shingles of each size
    places = source.select("id", "k", "kept", "w", F.posexplode(F.concat(F.array(F.lit(-1).cast("long")), *[_hashes(F.col("w"), s) for s in sizes])).alias("p", "h"))
    n, before, first = F.size("w"), F.lit(0), {}
    for s in sizes:
        first[s] = before
        before = before + F.greatest(F.lit(0), n - (s - 1))
    at = F.col("p") - (F.coalesce(*[F.when(F.col("s") == s, first[s]) for s in sizes], F.lit(0)) if len(sizes) > 1 else F.lit(0))
    reach = F.lit(window) - F.col("s")
    hits = places.join(marked, "h").where("(s = 0) = (p = 0)").select("id", "k", F.when(F.col("p") == 0, F.col("kept")).alias("kept"), n.alias("n"), at.alias("p"), "h", "s", reach.alias("reach"), "w")
    around = F.when(F.col("p") > 0, F.slice("w", F.greatest(F.lit(1), F.col("p") - F.col("reach")), 2 * F.col("reach") + F.col("s")))
    return hits.select("id", "k", "kept", "n", "p", "h", around.alias("around"), "s", "reach")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, items (sorted strings), contaminated, and the columns in keep as one struct `kept`."""
    windows = stored(benchmark_windows(items, window, item_col, item_text_col))
    sizes = sorted(r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect())  # at most SHINGLE values
    shingled = [windows.where(F.least("size", F.lit(SHINGLE)) == s).select("words", "size", "items", F.posexplode(_hashes(F.col("words"), s)).alias("offset", "h")).withColumn("s", F.lit(s)) for s in sizes]
    every = shingled[0] if sizes else windows.select("words", "size", "items", F.lit(0).alias("offset"), F.lit(0).cast("long").alias("h"), F.lit(SHINGLE).alias("s")).limit(0)
    for more in shingled[1:]:
        every = every.unionAll(more)
    marked = stored(every.select("h", "s").distinct())
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("k"), F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"), words_of(text).alias("w"))
    if sizes and marked.count() > BROADCAST_ROWS:
        found = stored(_found_by_shuffle(source, marked, sizes, window))
        result = source.select("id", "k", "kept", F.size("w").alias("n"))
    else:
        found = stored(_found_by_broadcast(source, marked, sizes, window))
        result = found.where("p = 0").select("id", "k", "kept", "n")
    reach = F.lit(window) - F.col("s")
    rarity = found.where("p > 0").groupBy("s", "h").agg(F.count("*").alias("often"))
    # a shingle that no document has gives a window that none has
    counted = every.join(rarity, ["s", "h"], "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = counted.groupBy("words", "size", "s").agg(F.min(F.struct("often", "h", "offset")).alias("r"), F.first("items").alias("items")).where("r.often > 0")
    prefix = prefix.select("words", "size", "s", "items", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"))
    start = F.col("p") - 1 - F.col("offset")
    from_ = start - F.greatest(F.lit(0), F.col("p") - 1 - F.col("reach"))
    candidates = found.where("p > 0").join(prefix, ["s", "h"]).where((start >= 0) & (start + F.col("size") <= F.col("n")))
    matched = candidates.where(F.slice("around", from_ + 1, F.col("size")) == F.col("words")).select("id", "k", start.alias("start"), (start + F.col("size")).alias("end"), "items")
    spans = matched.groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["to"], x["start"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"].cast("long"),
    )
    hit = stored(spans.select("id", "k", covered.alias("n_hit"), "items")).alias("h")
    joined = result.alias("r").join(hit, F.col("r.id").eqNullSafe(F.col("h.id")) & (F.col("r.k") == F.col("h.k")), "left").select("r.id", "r.kept", "r.n", "h.n_hit", "h.items")
    n_words, n_hit = F.col("n").cast("long"), F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * 20 >= n_words)).alias("contaminated"), "kept")
