"""Product codes of vectors: a codebook for each part, learnt in exact integers.

Components become floor(1024 * x); a vector is cut into equal consecutive parts, and each part has a codebook that
starts as that part of the smallest ids. In each round the codebooks go to the tasks as kd-trees (at most 256 entries a
part, so their size has a bound), each part takes the nearest entry, and tasks send one row of integer sums for each
part and entry that they met. Rows are never collected, and a vector that a third of all rows repeat is summed where
it is read.

The search is branch and bound for a whole batch at once: a group of queries goes down the nearer side first, and
those queries visit the other side whose distance to its box is at most their best so far. Boxes at exactly the best
distance are visited too, so that of equally near entries the lower index is found.

Defined cases: rows whose vector is null, or holds null or a component that is not finite, are dropped. So are
vectors whose length is not that of the row that comes first (by id, then vector) among those whose length is a positive
multiple of the number of parts. Null ids come last where the smallest ids are taken; equal ids stand in the order of
their vectors, and repeated rows all count. With fewer rows than entries, codebooks are smaller. An empty table gives
no rows. Null labels are one label. Other columns are not looked at. Components so large that squared distances would
leave 63 bits (beyond some 200,000 for parts of 16) raise an error instead of a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

#: Entries of a leaf of a tree.
LEAF = 16
#: Distances' components that one look-up holds at a time: 4096 rows of parts of 16.
HELD = 1 << 20
#: Rows that tasks look up together.
BATCH = 8192
#: Tasks that rows of one label are dealt to when they get the label's error.
LABEL_SPLITS = 16


@dataclass
class Node:
    """A box around some entries: a leaf has entries, an inner node two sides."""

    low: np.ndarray
    high: np.ndarray
    index: np.ndarray | None = None
    entries: np.ndarray | None = None
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, index: np.ndarray | None = None) -> Node:
    """Split at the median of the widest dimension until LEAF entries are left."""
    index = np.arange(len(entries)) if index is None else index
    own = entries[index]
    low, high = own.min(axis=0), own.max(axis=0)
    if len(index) <= LEAF:
        return Node(low, high, index=index, entries=own)
    order = index[np.argsort(own[:, np.argmax(high - low)], kind="stable")]
    half = len(order) // 2
    return Node(low, high, left=kd_tree(entries, np.sort(order[:half])), right=kd_tree(entries, np.sort(order[half:])))


def _to_box(x: np.ndarray, node: Node) -> np.ndarray:
    off = np.maximum(np.maximum(node.low - x, x - node.high), 0)
    return np.einsum("ij,ij->i", off, off)


def nearest(tree: Node, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of x (the lowest of equally near ones) and its squared distance."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    found = np.full(len(x), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray, bound: np.ndarray) -> None:
        stays = bound <= best[rows]  # the best may have come nearer since the bound was taken
        rows = rows[stays]
        if not len(rows):
            return
        if node.entries is not None:
            off = x[rows, None, :] - node.entries[None]
            d = np.einsum("ijk,ijk->ij", off, off)
            at = d.argmin(axis=1)  # the first of equal ones, and a leaf's indexes ascend
            near, which = d[np.arange(len(rows)), at], node.index[at]
            better = (near < best[rows]) | (near == best[rows]) & (which < found[rows])
            best[rows[better]], found[rows[better]] = near[better], which[better]
            return
        left, right = _to_box(x[rows], node.left), _to_box(x[rows], node.right)
        first = left <= right
        for side, mine in ((node.left, first), (node.right, ~first), (node.right, first), (node.left, ~first)):
            visit(side, rows[mine], (left if side is node.left else right)[mine])

    step = max(1, HELD // (LEAF * max(1, x.shape[1])))
    for start in range(0, len(x), step):
        rows = np.arange(start, min(start + step, len(x)))
        visit(tree, rows, _to_box(x[rows], tree))
    return found, best


def _scaled(vectors: pa.Array, scale: int, limit: int) -> np.ndarray:
    x = np.floor(np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1) * scale)
    if x.size and np.abs(x).max() > limit:
        raise ValueError(f"components beyond {limit / scale:g} would overflow squared distances")
    return x.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH rows, however small Spark's are."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _usable(column: str) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.col(column).isNotNull() & F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


@dataclass
class Codebooks:
    """entries: for each part, its entries as rows of integers."""

    entries: list[np.ndarray]
    scale: int
    width: int

    def sha256(self) -> str:
        """Of all components as decimal text, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()

    @property
    def limit(self) -> int:
        """Components up to here keep every squared distance of all parts below 2**62."""
        return int((2**60 / max(1, self.width)) ** 0.5)


def usable_rows(df: DataFrame, vector: str, parts: int, order: list[str]) -> tuple[DataFrame, int]:
    """The rows of one length that can be coded, and that length: 0 without any."""
    rows = df.where(_usable(vector))
    first = rows.where((F.size(vector) > 0) & (F.size(vector) % parts == 0)).orderBy(*[F.col(c).asc_nulls_last() for c in order]).select(F.size(vector)).head(1)
    width = first[0][0] if first else 0
    return rows.where(F.size(vector) == width) if width else rows.where("false"), width


def learn(rows: DataFrame, vector: str, id_col: str, width: int, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks after `rounds` rounds; rows: all of one width."""
    head = rows.orderBy(F.col(id_col).asc_nulls_last(), vector).select(vector).limit(entries).toArrow()  # `entries` rows at most
    books = Codebooks([], scale, width)
    start = _scaled(head.column(0).combine_chunks(), scale, books.limit)
    books.entries = [np.ascontiguousarray(e) for e in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        for r in sums(rows.select(vector), books).collect():  # a row for each part and entry at most
            books.entries[r.part][r.entry] = [s // r.n for s in r.sums]  # towards minus infinity
    return books


def _assigned(vectors: pa.Array, books: Codebooks, trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its rows of integers, the nearest entries, the squared distances."""
    x = _scaled(vectors, books.scale, books.limit)
    for part, tree in zip(np.split(x, len(trees), axis=1), trees, strict=True):
        yield part, *nearest(tree, part)


def sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """part, entry, n, sums (per position) of the parts that are nearest to each entry: one exchange of at most parts * entries rows a task."""
    spark, width = vectors.sparkSession, books.width // len(books.entries)
    sent = spark.sparkContext.broadcast((books, [kd_tree(e) for e in books.entries]))  # bounded by the number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros_like(e) for e in books.entries]
        for batch in _gathered(batches):
            for p, (part, entry, _) in enumerate(_assigned(batch.column(0), books, trees)):
                n[p] += np.bincount(entry, minlength=len(n[p]))
                order = np.argsort(entry, kind="stable")
                at = np.flatnonzero(np.diff(entry[order], prepend=-1))
                if len(at):
                    total[p][entry[order][at]] += np.add.reduceat(part[order], at, axis=0)
        for p in range(len(n)):
            met = np.flatnonzero(n[p])
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(met), p, np.int32)), "entry": pa.array(met.astype(np.int32)), "n": pa.array(n[p][met]), "sums": pa.array(total[p][met].tolist(), pa.list_(pa.int64()))})

    found = vectors.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def encode(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """rows with code (two hex digits a part) and error (squared distances summed over the parts) in place of the vector."""
    sent = rows.sparkSession.sparkContext.broadcast((books, [kd_tree(e) for e in books.entries]))  # bounded by the number of entries
    others = [c for c in rows.columns if c != vector]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*others).schema), "code string", "error long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = sent.value
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in _gathered(batches):
            code, error = np.full(batch.num_rows, ""), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                for _, entry, distance in _assigned(batch.column(0), books, trees):
                    code = np.char.add(code, digits[entry])
                    error += distance
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(code.tolist(), pa.string()), pa.array(error)], names=[*others, "code", "error"])

    return rows.select(vector, *others).mapInArrow(run, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error, label_error) of each usable row, and the codebooks (None without rows). entries: at most 256, as a code has two digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    df = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows, width = usable_rows(df, "v", parts, ["id", "v"])
    if not width:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    books = learn(rows, "v", "id", width, parts, entries, rounds, scale)
    coded = stored(encode(rows, "v", books))
    # the rows of a label meet in several tasks, each with a copy of the label's row
    split = F.lit(LABEL_SPLITS)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = by_label.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), split - 1)).alias("_split"))
    dealt = coded.withColumn("_split", F.pmod(F.xxhash64("id", "code", "error"), split).cast("int"))
    out = dealt.join(by_label, (dealt["_split"] == by_label["_split"]) & dealt["label"].eqNullSafe(by_label["_label"]))
    return out.select("id", "label", "code", "error", "label_error"), books
