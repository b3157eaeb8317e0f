"""Token counts of texts without encoding most of them: the whole-token shortcut.

A pre-token is merged by itself, whatever stands around it. So a vocabulary string that the pre-tokeniser leaves in
one piece, and whose own bytes merge to that one token, counts one wherever it is a pre-token. `whole_tokens` proves
this once for each string of the vocabulary, on the driver (the vocabulary file bounds the work and the set that is
broadcast). Tasks then look pre-tokens up in the set, and only what is not in it is merged, pair by pair, oldest
merge first.

Defined cases: null counts as an empty text, which has no bytes and no tokens; the text of a special token counts one,
as the library has it by default; pre-tokens of any length are merged whole, in n log n steps; equal rows give equal
results and an empty table an empty one; ids of any type, null ones too, are handed on; other columns are not looked
at. A file with another kind of model, normaliser, pre-tokeniser or decoder than byte-level BPE is refused.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHED, PATTERN, _Generations, byte_chars, check_spec
from .frames import small_batches

#: Bytes up to which the next pair is looked for in a list; longer pre-tokens take a heap.
SHORT = 100
_NONE = (1 << 60, -1)


class Merger:
    """Counts the tokens of one pre-token by its merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        latin = {c: chr(b) for b, c in enumerate(byte_chars())}
        plain = lambda t: "".join(latin[c] for c in t)
        self.vocab: dict[str, int] = {plain(t): i for t, i in spec["model"]["vocab"].items() if all(c in latin for c in t)}
        self.bytes = [self.vocab[chr(b)] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            a, b = plain(a), plain(b)
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(PATTERN)

    def tokens(self, piece: bytes) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost of equal ones, until none is left."""
        ids = [self.bytes[b] for b in piece]
        if len(ids) > SHORT:
            return self._by_heap(ids)
        get = self.merges.get
        pairs = [get(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while pairs and (least := min(pairs)) is not _NONE:
            i = pairs.index(least)
            ids[i : i + 2] = least[1:]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), _NONE)
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), _NONE)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        merges = self.merges
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(merges[pair][0], i, merges[pair][1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in merges]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            # the pair may have gone since: one of both merged away, or changed
            if ids[i] < 0 or j >= len(ids) or merges.get((ids[i], ids[j]), _NONE)[0] != rank:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (pair := (ids[left], ids[right])) in merges:
                    heapq.heappush(heap, (merges[pair][0], left, merges[pair][1]))
        return [i for i in ids if i >= 0]

    def whole_tokens(self) -> frozenset[str]:
        """The vocabulary strings that are proven to encode alone as one token."""
        found = []
        for latin, i in self.vocab.items():
            raw = latin.encode("latin-1")
            try:
                text = raw.decode()
            except UnicodeDecodeError:  # a part of a character is never a pre-token
                continue
            if self.pieces.findall(text) == [text] and not any(s in text for s in self.special) and self.tokens(raw) == [i]:
                found.append(text)
        return frozenset(found)


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(2)
def whole_tokens(path: str) -> frozenset[str]:
    return merger(path).whole_tokens()


class Counter:
    def __init__(self, path: str, whole: frozenset[str]):
        m = merger(path)
        self.whole, self.pieces = whole, m.pieces
        self.special = regex.compile("|".join(map(regex.escape, m.special))) if m.special else None
        # what a pre-token counts beyond one
        self.more = _Generations(lambda piece: len(m.tokens(piece.encode())) - 1, longest=CACHED)

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        found, whole = self.pieces.findall(text), self.whole
        return len(found) + sum(map(self.more.__getitem__, [p for p in found if p not in whole]))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens). path: a byte-level BPE in the tokenizers format, readable on every executor."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # no more than the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
