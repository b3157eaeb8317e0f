"""The prefix trie of conversations, by an external mergesort that keeps common prefixes.

A turn is named by 128 bits of the SHA-256 of its role and text, a conversation is the sequence of its turns' names.
Conversations are dealt by ranges of (sequence, id), so that copies of one conversation fall to several tasks. Each
task sorts them in runs of bounded size, whose rows carry the length of the prefix they share with the row before
(LCP) and only the names after it; blocks of the runs go through Spark's own sort by their first row, which can spill.
A loser tree merges the runs: the LCPs decide most comparisons, others start behind the shared turns. It holds one
block of each run: the next unread block is a stream of its own, known by its first row, and is opened when it wins.
The merged rows pass a stack of open nodes; a node is finished when a row leaves it.

Nodes on the first or last path of a task may go on in the next one ("edge" nodes, at most twice the longest
conversation a task). Their parts are added up in order by one short sweep over all edges, and the ids that end
in one are hashed from chunks in order. All other nodes are whole in their task: a second pass, backwards, hands each
of them its parent's id. Only children of edge nodes look for it by a join.

Defined cases: a null turn comes first, equal turns stand by role and then by the hash of their text; null roles and texts are
empty; rows without conv_id belong to no conversation; a conversation may have no turns; an empty table has no nodes,
not even a root; repeated rows are turns like any other; other columns are not looked at. A conversation is held as
one row (16 bytes and a size a turn).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import small_batches, stored

#: Bytes of names and conversations that a run is sorted from, at most (a longer conversation is a run of its own).
RUN_BYTES, RUN_ROWS = 8 << 20, 50_000
#: The same of a block.
BLOCK_BYTES, BLOCK_ROWS = 64 << 10, 1_000
#: Characters of ids in a chunk.
CHUNK = 1 << 16
NAME = 16
#: Tasks that the children of an edge node are dealt to.
SPLITS = 16

Path = list[bytes]


# --- conversations as sequences ---


def turn_name(role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, F.coalesce(text, F.lit("")))
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, NAME)


def sequences(rows: DataFrame) -> DataFrame:
    """conv_id, path: names and sizes (code points) of the turns in order. rows: conv_id, turn, role, text."""
    role = F.coalesce("role", F.lit(""))
    turns = rows.where("conv_id is not null").select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), turn_name(F.col("role"), F.col("text")).alias("name"), F.coalesce(F.char_length("text"), F.lit(0)).alias("size")).alias("t")
    )
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size")))
    return turns.groupBy("conv_id").agg(ordered.alias("path"))


def rebuilt(convs: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of c - c % family; h = crc32 of c as text, modulo heads. A family has at most 2 * family members, so no key of the join is hot."""
    longest = heads - 1
    base = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, longest).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = convs.withColumns({"_h": h, "_base": F.col("conv_id") - F.col("conv_id") % family}).join(base, "_base", "left")
    head = F.coalesce(F.slice("_head", F.lit(1), F.col("_h")), F.slice("path", 1, 0))
    own = F.when(F.size("path") > F.col("_h"), F.slice("path", F.col("_h") + 1, F.greatest(F.size("path") - F.col("_h"), F.lit(1)))).otherwise(F.slice("path", 1, 0))
    return both.select("conv_id", F.concat(head, own).alias("path"))


# --- sorted runs ---


def common(a: Path, b: Path, start: int = 0) -> int:
    """Length of the shared prefix, of which `start` names are known."""
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


Row = tuple[int, Path, list[int], int]  # LCP with the row before, names, sizes, conv_id


def pack(rows: list[Row]) -> bytes:
    """Front coding: the first row whole, of others what follows the shared prefix."""
    lcps = [0, *(r[0] for r in rows[1:])]
    counts = [len(r[1]) for r in rows]
    names = b"".join(b"".join(r[1][n:]) for r, n in zip(rows, lcps, strict=True))
    sizes = [s for r, n in zip(rows, lcps, strict=True) for s in r[2][n:]]
    return b"".join([struct.pack("<ii", len(rows), rows[0][0]), np.array(lcps, "<i4").tobytes(), np.array(counts, "<i4").tobytes(), np.array([r[3] for r in rows], "<i8").tobytes(), np.array(sizes, "<i8").tobytes(), names])


def unpack(body: bytes) -> Iterator[Row]:
    n, first = struct.unpack_from("<ii", body)
    at = 8
    lcps = np.frombuffer(body, "<i4", n, at)
    counts = np.frombuffer(body, "<i4", n, at + 4 * n)
    convs = np.frombuffer(body, "<i8", n, at + 8 * n).tolist()
    new = (counts - lcps).tolist()
    at += 16 * n
    sizes = np.frombuffer(body, "<i8", sum(new), at).tolist()
    at += 8 * len(sizes)
    path, held, s = [], [], 0
    for i, (lcp, more) in enumerate(zip(lcps.tolist(), new, strict=True)):
        path = path[:lcp] + [body[at + NAME * k : at + NAME * (k + 1)] for k in range(s, s + more)]
        held = held[:lcp] + sizes[s : s + more]
        s += more
        yield (first if i == 0 else lcp), path, held, convs[i]


BLOCK = pa.schema([("kind", pa.int32()), ("first", pa.list_(pa.binary())), ("conv_id", pa.int64()), ("run", pa.int32()), ("body", pa.binary())])
BLOCK_DDL = "kind int, first array<binary>, conv_id long, run int, body binary"


def _blocks(run: int, rows: list[tuple[Path, int, list[int]]]) -> Iterator[dict]:
    rows.sort(key=lambda r: (r[0], r[1]))
    held: list[Row] = []
    size, before = 0, None
    for path, conv, sizes in rows:
        lcp = common(before, path) if before is not None else 0
        before = path
        if held and (size >= BLOCK_BYTES or len(held) >= BLOCK_ROWS):
            yield {"kind": 1, "first": held[0][1], "conv_id": held[0][3], "run": run, "body": pack(held)}
            held, size = [], 0
        held.append((lcp, path, sizes, conv))
        size += (NAME + 8) * (len(path) - lcp if len(held) > 1 else len(path)) + 16
    yield {"kind": 1, "first": held[0][1], "conv_id": held[0][3], "run": run, "body": pack(held)}


def form_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted runs of a task's conversations, and a row of kind 0 with its last path."""
    held: list[tuple[Path, int, list[int]]] = []
    size = run = 0
    last: Path = []

    def flush() -> Iterator[pa.RecordBatch]:
        for block in _blocks(run, held):
            yield pa.RecordBatch.from_pylist([block], BLOCK)

    for batch in batches:
        for conv, turns in zip(batch.column(0), batch.column(1), strict=True):
            turns = turns.as_py()
            path = [t["name"] for t in turns]
            last = max(last, path)
            held.append((path, conv.as_py(), [t["size"] for t in turns]))
            size += (NAME + 8) * len(path) + 16
            if size >= RUN_BYTES or len(held) >= RUN_ROWS:
                yield from flush()
                held, size, run = [], 0, run + 1
    if held:
        yield from flush()
    if held or run:
        yield pa.RecordBatch.from_pylist([{"kind": 0, "first": last, "conv_id": None, "run": -1, "body": b""}], BLOCK)


# --- the merge ---


class Stream:
    """A run that gives its rows block by block. lcp: with the last row that the merge put out."""

    __slots__ = ("lcp", "path", "sizes", "conv", "rows")

    def __init__(self, rows: Iterator[Row]):
        self.rows = rows
        self.next()

    def next(self) -> None:
        self.lcp, self.path, self.sizes, self.conv = next(self.rows, (0, None, [], 0))


class LoserTree:
    """Each inner node keeps the loser of its two sides and the LCP of that loser with the winner it lost to."""

    def __init__(self, streams: list[Stream]):
        self.n = 1 << max(0, (len(streams) - 1).bit_length())
        self.leaves: list[Stream | None] = [*streams, *[None] * (self.n - len(streams))]
        self.losers: list[int] = [0] * self.n
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = self._play(a, b)
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). Both LCPs are with the same earlier row; the loser's becomes that with the winner."""
        x, y = self.leaves[a], self.leaves[b]
        if y is None or y.path is None:
            return a, b
        if x is None or x.path is None:
            return b, a
        if x.lcp != y.lcp:
            # the one that shares more with the earlier row comes first, and the other shares no more with it
            return (a, b) if x.lcp > y.lcp else (b, a)
        lcp = common(x.path, y.path, x.lcp)
        if lcp < len(x.path) and lcp < len(y.path):
            first = x.path[lcp] < y.path[lcp]
        elif len(x.path) != len(y.path):
            first = len(x.path) < len(y.path)
        else:
            first = x.conv <= y.conv
        if first:
            y.lcp = lcp
            return a, b
        x.lcp = lcp
        return b, a

    def top(self) -> Stream | None:
        found = self.leaves[self.winner]
        return None if found is None or found.path is None else found

    def replay(self) -> None:
        """After the winner has moved on: only its path to the root is played again."""
        at, node = self.winner, (self.winner + self.n) // 2
        while node:
            at, self.losers[node] = self._play(at, self.losers[node])
            node //= 2
        self.winner = at


def merged(blocks: Iterator[tuple[int, Path, int, bytes]]) -> Iterator[Row]:
    """All rows in order with their LCPs. blocks: (run, first path, first conv_id, body), sorted by path and id."""
    runs: dict[int, Stream] = {}
    last: Path = []
    ahead = next(blocks, None)
    while ahead is not None or runs:
        # (re)build: once for each block, so that its cost is spread over the block's rows
        streams = []
        for run, s in list(runs.items()):
            if s.path is None:
                del runs[run]
                continue
            s.lcp = common(last, s.path)
            streams.append(s)
        unread = None
        if ahead is not None:
            unread = Stream(iter([(common(last, ahead[1]), ahead[1], [], ahead[2])]))
            streams.append(unread)
        tree = LoserTree(streams)
        while (s := tree.top()) is not None and s is not unread:
            last = s.path
            yield s.lcp, s.path, s.sizes, s.conv
            s.next()
            tree.replay()
        if unread is not None:
            held = runs.get(ahead[0])
            if held is not None and held.path is not None:  # rows equal to the block's first are still to come
                held.rows = chain(held.rows, unpack(ahead[3]))
            else:
                runs[ahead[0]] = Stream(unpack(ahead[3]))
            ahead = next(blocks, None)


# --- the open-path stack ---


@dataclass(slots=True)
class Open:
    key: bytes
    size: int  # code points of its last text
    edge: bool  # on the first or last path of the task
    side: int = 0  # of an edge node: 0 on the first path, 1 only on the last
    conv: int = 1 << 63
    n: int = 0
    children: int = 0
    leaves: int = 0  # of finished subtrees
    saved: int = 0
    ends: object = field(default=None)  # a hash of the ids that end here; of an edge node, their text

    def members_into(self, other: Open) -> None:
        other.n += self.n
        other.conv = min(other.conv, self.conv)

    def finish_into(self, parent: Open | None) -> None:
        """All members and children are known."""
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.size
        if parent is not None:
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved


ROOT = b"\0" * NAME


def child_key(key: bytes, name: bytes) -> bytes:
    return hashlib.sha256(key + name).digest()[:NAME]


NODE = pa.schema(
    [
        *((c, pa.string()) for c in ("kind", "ids")),
        *((c, pa.int32()) for c in ("part", "side")),
        *((c, pa.int64()) for c in ("at", "depth", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent_conv_id")),
        *((c, pa.binary()) for c in ("key", "parent")),
        ("wide", pa.bool_()),
        ("ends_sha256", pa.string()),
    ]
)
NODE_DDL = "kind string, ids string, part int, side int, at long, depth long, size long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, key binary, parent binary, wide boolean, ends_sha256 string"
OUT_ROWS = 2_000
EMPTY = hashlib.sha256(b"").hexdigest()


class Trie:
    """Takes sorted rows with LCPs, gives rows of NODE: kind `node` for whole nodes, `edge` for parts of edge nodes, `ids` for chunks of ids that end in edge nodes."""

    def __init__(self, part: int, last: Path):
        self.part, self.last, self.at = part, last, 0
        self.stack = [Open(ROOT, 0, True)]
        self.on_last = 0  # nodes of the stack below the root that lie on the last path
        self.started = False
        self.rows: list[dict] = []

    def _put(self, **row) -> None:
        self.rows.append({"part": self.part, "at": self.at, **row})
        self.at += 1

    def _close(self, depth: int) -> None:
        """Finish the nodes deeper than `depth`."""
        stack = self.stack
        while len(stack) - 1 > depth:
            node = stack.pop()
            d, parent = len(stack), stack[-1]
            node.members_into(parent)
            if node.edge:
                self._edge(node, d, parent.key)
                continue
            node.finish_into(parent)
            self._put(kind="node", depth=d, conv_id=node.conv, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, key=node.key, parent=parent.key, wide=parent.edge, ends_sha256=node.ends.hexdigest() if node.ends else EMPTY)

    def _edge(self, node: Open, depth: int, parent: bytes | None) -> None:
        self._flush_ids(node)
        self._put(kind="edge", side=node.side, depth=depth, size=node.size, conv_id=node.conv, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, key=node.key, parent=parent)

    def _flush_ids(self, node: Open) -> None:
        if node.ends:
            self._put(kind="ids", key=node.key, ids=",".join(node.ends))
            node.ends = []

    def add(self, row: Row) -> None:
        lcp, path, sizes, conv = row
        stack = self.stack
        self._close(lcp)
        self.on_last = min(self.on_last, lcp)
        for d in range(len(stack), len(path) + 1):
            name = path[d - 1]
            if self.on_last == d - 1 and d <= len(self.last) and self.last[d - 1] == name:
                self.on_last = d
            stack.append(Open(child_key(stack[-1].key, name), sizes[d - 1], not self.started or self.on_last == d, int(self.started)))
        self.started = True
        node = stack[-1]
        node.n += 1
        node.conv = min(node.conv, conv)
        if node.edge:
            node.ends = node.ends or []
            node.ends.append(str(conv))
            if len(node.ends) * 20 >= CHUNK:
                self._flush_ids(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(f",{conv}".encode())

    def end(self) -> None:
        self._close(0)
        self._edge(self.stack[0], 0, None)


def build_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a task's blocks, sorted by (kind, first, conv_id), into rows of NODE."""
    found = ((kind, first.as_py(), conv, run, body.as_py()) for b in batches for kind, first, conv, run, body in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True))
    head = next(found, None)
    if head is None:
        return
    trie = Trie(TaskContext.get().partitionId(), head[1])
    for row in merged((run, first, conv, body) for _, first, conv, run, body in found):
        trie.add(row)
        if len(trie.rows) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(trie.rows, NODE)
            trie.rows = []
    trie.end()
    yield pa.RecordBatch.from_pylist(trie.rows, NODE)


def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, the last first: a node comes after its parent, and takes its id unless the parent is an edge node."""
    open_ids: list[int | None] = []
    for b in batches:
        names = b.schema.names
        out = []
        for kind, depth, conv, wide in zip(*(b.column(names.index(c)).to_pylist() for c in ("kind", "depth", "conv_id", "wide")), strict=True):
            if kind != "node":
                out.append(None)
                continue
            open_ids[depth:] = []
            open_ids += [None] * (depth - len(open_ids))
            out.append(None if wide else open_ids[depth - 1])
            open_ids.append(conv)
        yield b.set_column(names.index("parent_conv_id"), "parent_conv_id", pa.array(out, pa.int64()))


# --- what goes on from task to task ---


def add_up_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all edge nodes, by (part, side, depth), as whole nodes. One pass with a stack."""
    stack: list[tuple[Open, bytes | None]] = []
    rows: list[dict] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node, parent = stack.pop()
            node.finish_into(stack[-1][0] if stack else None)
            rows.append({"kind": "node", "depth": len(stack), "conv_id": node.conv, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "key": node.key, "parent": parent, "wide": True})

    for b in batches:
        for r in b.to_pylist():
            d = r["depth"]
            if d >= len(stack) or stack[d][0].key != r["key"]:
                close(d)
                stack.append((Open(r["key"], r["size"], True), r["parent"]))
            node = stack[d][0]
            node.n += r["n_convs"]
            node.conv = min(node.conv, r["conv_id"])
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
        if len(rows) >= OUT_ROWS:
            yield pa.RecordBatch.from_pylist(rows, NODE)
            rows = []
    close(0)
    yield pa.RecordBatch.from_pylist(rows, NODE)


def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of chunks of ids by (key, part, at); only the hash's state is held."""
    key, state = None, None
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    for b in batches:
        done = []
        for k, ids in zip(b.column(0), b.column(1), strict=True):
            k, ids = k.as_py(), ids.as_py().encode()
            if k != key:
                if state is not None:
                    done.append({"key": key, "ends_sha256": state.hexdigest()})
                key, state = k, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie(convs: DataFrame) -> DataFrame:
    """COLUMNS, key and parent (16 bytes that name a node and the one above it) of each node. convs: conv_id, path as `sequences` gives them."""
    small_batches(convs.sparkSession)
    names = F.transform("path", lambda t: t["name"])
    dealt = stored(convs).withColumn("_names", names).repartitionByRange("_names", "conv_id").drop("_names")
    blocks = dealt.select("conv_id", "path").mapInArrow(form_runs, BLOCK_DDL).sortWithinPartitions("kind", "first", "conv_id")
    # sorts within tasks: runs, merge and the way back are one stage
    rows = stored(blocks.mapInArrow(build_nodes, NODE_DDL).sortWithinPartitions("part", F.desc("at")).mapInArrow(hand_down, NODE_DDL))
    # at most two paths of each task
    edges = rows.where("kind = 'edge'").repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(add_up_edges, NODE_DDL)
    ends = rows.where("kind = 'ids'").repartition("key").sortWithinPartitions("key", "part", "at").select("key", "ids").mapInArrow(hash_chunks, "key binary, ends_sha256 string")
    out = [*COLUMNS, "key", "parent"]
    edges = stored(edges.drop("ends_sha256").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*out))
    whole = rows.where("kind = 'node'")
    # a node of which a third of all nodes are children is an edge node: its children meet it in several tasks
    above = edges.select(F.col("key").alias("_above"), F.col("conv_id").alias("_id"), F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("_split"))
    below = whole.where("wide").select(*out).unionByName(edges).withColumn("_split", F.pmod(F.xxhash64("key"), F.lit(SPLITS)).cast("int"))
    below = below.join(above, (F.col("parent") == F.col("_above")) & (below["_split"] == above["_split"]), "left").withColumn("parent_conv_id", F.col("_id"))
    return whole.where("not wide").select(*out).unionByName(below.select(*out))
