"""Words and rolling hashes of whole texts, as numpy passes over Arrow string buffers.

A batch is worked on in slices of about SLICE bytes, so that temporaries stay small
whatever the batch holds; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

#: Separators of words `[^\x20\x09-\x0D]+`.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z, other bytes as they are (safe on UTF-8).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_SEED, _ROOT, _WORD_ROOT = 20240229, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _byte_table() -> np.ndarray:
    return np.random.default_rng(_BYTE_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """root**i and its inverse modulo 2**64 for i < n."""
    have = _powers.get(root)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(root, -1, 1 << 64)
        made = []
        for r in (root, inverse):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= 1 << 20:  # 16 MB a root; longer texts make theirs anew
            _powers[root] = have
    return have


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int) -> np.ndarray:
    """Hash of values[start:end] for each span; equal sequences have equal hashes."""
    up, down = powers(root, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of some whole texts. first[d]:first[d + 1] are the words of text d."""

    __slots__ = ("data", "starts", "ends", "first", "hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, blank: np.ndarray = BLANK):
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        if n:
            sep = blank[data]
            before = np.empty(n, bool)
            before[0], before[1:] = True, sep[:-1]
            after = np.empty(n, bool)
            after[-1], after[:-1] = True, sep[1:]
            inner = offsets[(offsets > 0) & (offsets < n)]
            before[inner] = True
            after[inner - 1] = True
            self.starts = np.flatnonzero(~sep & before)
            self.ends = np.flatnonzero(~sep & after) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = spans_hash(_byte_table()[data], self.starts, self.ends, _ROOT)

    def prefix_hash(self, which: np.ndarray, size: int) -> np.ndarray:
        """Of the first bytes of some words that have more; it differs from the hash of such a word."""
        return mix(spans_hash(_byte_table()[self.data], self.starts[which], self.starts[which] + size, _ROOT) + np.uint64(size))

    def grams(self, k: int) -> np.ndarray:
        """The hash of words i..i+k-1, for each i that has so many words after it in the slice (of any text)."""
        n = max(0, len(self.hashes) - k + 1)
        at = np.arange(n)
        return spans_hash(self.hashes, at, at + k, _WORD_ROOT)

    def sequence_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return spans_hash(self.hashes, starts, ends, _WORD_ROOT)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of about SLICE bytes, of whole texts."""
    data, offsets = text_buffers(texts)
    n, a = len(texts), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
