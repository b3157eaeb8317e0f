"""Removal of repeated word windows: a compressed FM-index per shard, fed by content-defined segments.

Every window of `length` words belongs to the leftmost smallest word-gram inside it, its anchor; equal
windows have equal anchors. The consecutive windows of one anchor occurrence form a segment. Segments
are dealt to shards by their anchor, so all places of a window meet in one shard, and a document is
matched only against shards that can hold its windows, not against all.

1. Anchors are counted (with map-side combine). Those that occur once go: their windows are unique.
2. An anchor all of whose segments are equal needs no search: all its windows repeat.
3. The distinct segments of the other anchors go to shards. Each shard builds an FM-index (wavelet
   matrix over the Burrows-Wheeler transform, words as symbols), streams the segments through backward
   search and reports the intervals of windows that occur at least twice.
4. An anchor with over HOT unequal segments would make a shard of its own that grows
   with the corpus. Its windows are counted by fingerprint instead, again with map-side combine.

Words are compared by 64-bit hashes (40 bits within an anchor's segments), a segment by its anchor's and
its own (128 bits together).

Defined cases: null text has no words; a text shorter than the window keeps all its words; rows that
repeat count as places of their own; rows with a null or repeated id are told apart by their text;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .frames import small_batches, stored, text_key
from .words import Words, slices

#: Words of an anchor; about 2 in (length - ANCHOR + 2) positions become anchors.
ANCHOR = 12
#: Bytes of a word's hash in a shard, where only segments of one anchor are compared with each other.
SYMBOL = 5
#: Places of segments that a shard is made for.
SHARD = 200_000
#: Unequal segments from which an anchor is counted by fingerprints.
HOT = 20_000

_SEGMENTS = "h long, c long, id long, k long, at long"
#: at = first window * _PACK + number of windows; an anchor has fewer windows than _PACK.
_PACK = 1 << 12


def _segments(w: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows, document) of each segment."""
    n, span = len(w.hashes), length - anchor + 1
    if n < length:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    value = w.grams(anchor)
    place = np.arange(len(value), dtype=np.int32)
    best, have = value, 1
    while have < span:  # the leftmost minimum over the next `have` grams
        step = min(have, span - have)
        left, right = best[:-step], best[step:]
        take = left <= right
        place = np.where(take, place[:-step], place[step:])
        best = np.where(take, left, right)
        have += step
    windows = np.maximum(0, np.diff(w.first) - length + 1)
    doc = np.repeat(np.arange(len(windows)), windows)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(w.first[:-1], windows)
    if not len(start):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    own = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return value[own[at]], start[at], np.diff(np.append(at, len(start))), doc[at]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _segment_mapper(length: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = (batch.column(i) for i in range(3))
            for a, _, data, offsets in slices(texts):
                w = Words(data, offsets, lower=False)
                h, start, n, doc = _segments(w, length, anchor)
                c = w.sequence_hash(start, start + n + length - 1)
                row = pa.array(doc + a)
                at = (start - w.first[doc]) * _PACK + n
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(c), ids.take(row), keys.take(row), pa.array(at)], names=["h", "c", "id", "k", "at"])

    return run


def _content_mapper(length: int):
    """Texts with their segments (h, c, at) to (h, c, words): the content of each, once a slice; words is null and c the window's fingerprint for hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts, lists = (batch.column(i) for i in range(4))
            first = np.asarray(lists.offsets)
            flat = lists.values
            h, c, at, hot = (np.asarray(flat.field(i)) for i in range(4))
            for a, b, data, offsets in slices(texts):
                w = Words(data, offsets, lower=False)
                lo, hi = first[a], first[b]
                doc = np.repeat(np.arange(a, b), np.diff(first[a : b + 1]))
                base = w.first[doc - a]
                start, n = base + at[lo:hi] // _PACK, at[lo:hi] % _PACK
                cold = np.flatnonzero(~hot[lo:hi])
                _, once = np.unique(c[lo:hi][cold], return_index=True)
                pick = cold[once]
                short = w.hashes.view(np.uint8).reshape(-1, 8)[:, :SYMBOL].copy()
                words = [short[s : s + m + length - 1].tobytes() for s, m in zip(start[pick].tolist(), n[pick].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi][pick]), pa.array(c[lo:hi][pick]), pa.array(words, pa.binary()), pa.array([None] * len(pick), pa.int64()), pa.array([None] * len(pick), pa.int64()), pa.array([None] * len(pick), pa.int64())], names=["h", "c", "words", "id", "k", "at"])
                warm = np.flatnonzero(hot[lo:hi])
                if len(warm):
                    m = n[warm]
                    which = np.repeat(warm, m)
                    window = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m) + start[which]
                    prints = w.sequence_hash(window, window + length)
                    row = pa.array(doc[which])
                    yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi][which]), _signed(prints), pa.array([None] * len(which), pa.binary()), ids.take(row), keys.take(row), pa.array(window - base[which])], names=["h", "c", "words", "id", "k", "at"])

    return run


def _shard_search(length: int):
    """One shard: all distinct segments of its anchors, to the runs of repeated windows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        h, c = np.asarray(table["h"].chunk(0)), np.asarray(table["c"].chunk(0))
        order = np.lexsort((c, h))
        once = np.sort(order[np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))])
        h, c = h[once], c[once]
        words = table["words"].chunk(0).take(pa.array(once))
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] // SYMBOL
        packed = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] * SYMBOL : ends[-1] * SYMBOL].reshape(-1, SYMBOL)
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, :SYMBOL] = packed
        values = wide.reshape(-1).view(np.uint64)
        lengths = np.diff(ends).astype(np.int64)
        runs = FMIndex(values, lengths).repeated_windows(lengths - length + 1, length)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(runs, pa.list_(pa.int64()))], names=["h", "c", "runs"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k and text; k tells texts of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_key(text_col), F.lit(0)).alias("k"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(id, k, span) of stretches of windows that repeat: k tells rows of one id apart, span = first word << 32 | word after the last. Stretches may overlap."""
    small_batches(docs.sparkSession)
    anchor = min(anchor, length)
    if length - anchor + 2 > _PACK:
        raise ValueError(f"a window may have up to {_PACK + anchor - 2} words")
    texts = _keyed(docs, id_col, text_col)
    segments = texts.mapInArrow(_segment_mapper(length, anchor), _SEGMENTS)
    counts = segments.groupBy("h").agg(F.count("*").alias("places"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("places > 1")
    # stored, so that the join below is of two plain exchanges and a frequent anchor can be split over tasks
    counts = stored(counts.select("h", (F.col("c0") != F.col("c1")).alias("several"), (F.col("places") > hot).alias("hot")))
    repeated = stored(segments.join(counts, "h"))
    wide = stored(repeated.where("several and hot").select("h", "c").distinct().groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > hot).select("h", F.lit(True).alias("wide")))
    any_hot = not wide.isEmpty()
    repeated = repeated.drop("hot").join(wide, "h", "left").select("h", "c", "id", "k", "at", "several", F.coalesce("wide", F.lit(False)).alias("hot")) if any_hot else repeated.withColumn("hot", F.lit(False))

    def spans(df: DataFrame, first, last) -> DataFrame:
        return df.select("id", "k", (F.shiftleft(first.cast("long"), 32) + last + F.lit(length)).alias("span"))

    start = F.floor(F.col("at") / F.lit(_PACK))
    plain = spans(repeated.where("not several"), start, start + F.col("at") % _PACK - 1)
    several = repeated.where("several")
    lists = several.groupBy("id", "k").agg(F.collect_list(F.struct("h", "c", "at", "hot")).alias("segments"))
    t, s = texts.alias("t"), lists.alias("s")
    joined = t.join(s, F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.k") == F.col("s.k"))).select("t.id", "t.k", "t.text", "s.segments")
    content = joined.mapInArrow(_content_mapper(length), "h long, c long, words binary, id long, k long, at long")
    multiplicity = several.where("not hot").groupBy("h", "c").agg(F.count("*").alias("copies"))
    # a shard holds SHARD segments or so, so that its index fits a task whatever the corpus
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), several.count() // SHARD + 1)
    shards = content.where("words is not null").select("h", "c", "words").repartition(parts, "h")
    found = shards.mapInArrow(_shard_search(length), "h long, c long, runs array<bigint>")
    # stored, so that the join below is of two plain exchanges and a segment of many copies can be split over tasks
    judged = stored(multiplicity.join(found, ["h", "c"]).where("copies > 1 or size(runs) > 0").select("h", "c", "copies", "runs"))
    matched = several.where("not hot").join(judged, ["h", "c"])
    runs = F.when(F.col("copies") > 1, F.array(F.lit(0).cast("long"), F.col("at") % _PACK - 1)).otherwise(F.col("runs"))
    pairs = matched.select("id", "k", "at", F.explode(_pairs(runs)).alias("run"))
    searched = spans(pairs, start + F.col("run.a"), start + F.col("run.b"))
    windows = content.where("words is null").drop("words")
    if not any_hot:
        return plain.unionAll(searched)
    twice = windows.groupBy("h", "c").agg(F.count("*").alias("places")).where("places > 1").select("h", "c")
    printed = spans(windows.join(twice, ["h", "c"]), F.col("at"), F.col("at"))
    return plain.unionAll(searched).unionAll(printed)


def _pairs(runs):
    return F.transform(F.sequence(F.lit(0), F.size(runs) - 2, F.lit(2)), lambda i: F.struct(F.get(runs, i).alias("a"), F.get(runs, i + 1).alias("b")))


def _removal(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = (batch.column(i) for i in range(3))
            out: list[list] = [[], [], [], []]
            for text, spans in zip(texts, lists, strict=True):
                words = (text.as_py() or "").encode().split()  # bytes.split() cuts at \x20 and \x09-\x0D
                removed = 0
                if (values := spans.values) is not None and len(values):
                    packed = np.asarray(values)
                    edge = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edge, packed >> 32, 1)
                    np.add.at(edge, packed & 0xFFFFFFFF, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed = len(words) - int(keep.sum())
                    words = compress(words, keep.tolist())
                    kept = b" ".join(words)
                    count = len(keep)
                else:
                    kept, count = b" ".join(words), len(words)
                for column, value in zip(out, (count, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, **how) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; null if with_text is off)."""
    spans = repeated_spans(docs, length, id_col, text_col, **how)
    lists = spans.groupBy("id", "k").agg(F.collect_set("span").alias("spans")).alias("s")
    t = _keyed(docs, id_col, text_col).alias("t")
    joined = t.join(lists, F.col("t.id").eqNullSafe(F.col("s.id")) & (F.col("t.k") == F.col("s.k")), "left").select("t.id", "t.text", "s.spans")
    return joined.mapInArrow(_removal(with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
