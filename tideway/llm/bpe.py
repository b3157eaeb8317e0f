"""Byte-level BPE without merge loops: dynamic programming over prefixes.

Each prefix of a piece has one encoding, so the last token of every prefix says it all. A token that ends
at a position (found by an automaton with suffix links over the vocabulary) is the last token of that
prefix exactly if it is its own encoding and is compatible with the last token of the prefix before it.
Two tokens are compatible if undoing their merges, newest first, never meets a pair that would have been
merged across their border earlier. Back-pointers from the end then give the ids.

Tokens that end at a position are found by a keyword automaton with suffix links (the same matches as a suffix
automaton of the text would give, without one for each piece). Pieces of up to CACHED characters are cached in
two generations of bounded size, and the older one goes after each partition; a text is held one at a time.

Defined cases: null counts as an empty text and has no ids; the text of a special token becomes its id,
as in the library; pieces of any length are encoded whole; equal rows give equal results and an empty table an
empty one; ids that are no numbers raise an error under ANSI mode; other columns are not looked at. A file
with another kind of model, normaliser, pre-tokeniser or decoder than byte-level BPE is refused.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_batches

#: Pieces, and pairs of tokens, in one generation of a cache.
GENERATION = 1 << 17
#: Characters of the longest piece that is cached: a generation of pieces then holds some 60 MB at the very most.
CACHED = 64
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class _Generations(dict):
    """A cache of two generations: what is asked for again survives."""

    def __init__(self, make, longest: int = 0):
        super().__init__()
        self.make, self.old, self.longest = make, {}, longest

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.longest and len(key) > self.longest:
                return value
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def check_spec(spec: dict) -> None:
    """Refuse what the encoder would not encode as the library does."""
    model, first, last = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    flags = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(f) for f in flags) and spec.get("normalizer") is None
    bytewise = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True) and last.get("type") == "ByteLevel"
    added = not any(t.get(f) for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip"))
    if not (plain and bytewise and added):
        raise ValueError("only plain byte-level BPE is encoded here")


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        model = spec["model"]
        chars = byte_chars()
        latin = {c: chr(b) for b, c in enumerate(chars)}
        vocab: dict[str, int] = {"".join(latin[c] for c in t): i for t, i in model["vocab"].items() if all(c in latin for c in t)}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.bytes_of[i] = t.encode("latin-1")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.rank: dict[int, int] = {}  # of the pair of ids a << 32 | b
        self.parts: dict[int, tuple[int, int]] = {}  # of a merged token
        self.made: dict[int, int] = {}  # rank of the merge that makes a token; single bytes have none
        for r, (a, b) in enumerate(model["merges"]):
            a, b = "".join(latin[c] for c in a), "".join(latin[c] for c in b)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[x << 32 | y] = r
            if z not in self.parts:
                self.parts[z], self.made[z] = (x, y), r
        self.matches = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.matches.add_word(t, (i, len(t)))
        self.matches.make_automaton()
        self.own = _Generations(self._is_own)
        self.fits = _Generations(self._compatible)
        self.cache = _Generations(lambda piece: array("I", self.encode_piece(piece)).tobytes(), longest=CACHED)

    def _is_own(self, token: int) -> bool:
        """Is the token the encoding of its own bytes?"""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self.own[a] and self.own[b] and self._compatible(a << 32 | b, self.made[token])

    def _compatible(self, pair: int, before: int = 1 << 60) -> bool:
        """Do these tokens stay apart in every merge that is older than `before` and could join across their border?"""
        a, b = pair >> 32, pair & 0xFFFFFFFF
        limit = before  # merges from this rank on come too late to matter
        while True:
            if self.rank.get(a << 32 | b, limit) < limit:
                return False
            ra, rb = self.made.get(a, -1), self.made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # undo the newer of both merges; of two equal ones the left happened first, so the right goes first
            if ra > rb:
                a, limit = self.parts[a][1], min(limit, ra)
            else:
                b, limit = self.parts[b][0], min(limit, rb + 1)

    def encode_piece(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1")
        whole = self.matches.get(text, None)
        if whole is not None and self.own[whole[0]]:
            return [whole[0]]
        own, fits = self.own, self.fits
        last: list[int] = [-1] * (len(text) + 1)
        before: list[int] = [0] * (len(text) + 1)
        for end, (token, size) in self.matches.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if not own[token] or start and (last[start] < 0 or not fits[last[start] << 32 | token]):
                continue
            last[end], before[end] = token, start
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end = before[end]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers in the machine's order."""
        get = self.cache.__getitem__
        find = self.pieces.findall
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(get, find(text)))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += map(get, find(text[at : m.start()]))
            out.append(array("I", [self.special[m[0]]]).tobytes())
            at = m.end()
        out += map(get, find(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        numbers = array("I")
        numbers.frombytes(ids)
        if len(numbers) < 2:
            return b"".join(self.bytes_of[i] for i in numbers).decode(errors="replace")
        return b"".join(itemgetter(*numbers)(self.bytes_of)).decode(errors="replace")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _run(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            count, ids_sha, text_sha, parts = [], [], [], []
            for text in batch.column(1):
                ids = e.encode(text.as_py() or "")
                decoded = e.decode(ids)
                if sys.byteorder == "big":
                    ids = np.frombuffer(ids, np.uint32).astype("<u4").tobytes()
                count.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    parts.append(ids)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)
        for cache in (e.cache, e.fits, e.own):
            cache.old = {}

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. path: a byte-level BPE in the tokenizers format, readable on every executor."""
    small_batches(docs.sparkSession)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_run(path, with_ids), schema)
