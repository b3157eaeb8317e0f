"""A compressed FM-index over sequences of 64-bit symbols, with batched backward search.

The text is the concatenation of segments, each ended by a separator of its own. The Burrows-Wheeler
transform is kept as a wavelet matrix: one packed bit vector a level, with a running popcount.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with rank."""

    __slots__ = ("before", "words")

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        full = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        full[: len(packed)] = packed
        self.words = full.view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        at = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        """values: the segments' symbols one after another; lengths: of the segments."""
        n_seg, n = len(lengths), len(values) + len(lengths)
        self.alphabet, codes = np.unique(values, return_inverse=True)
        self.starts = np.zeros(n_seg, np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.starts[1:])
        text = np.empty(n, np.int64)
        ends = self.starts + lengths
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = codes + n_seg
        text[ends] = np.arange(n_seg)
        self.symbols = np.zeros(n, np.int32)  # 0 is any separator
        self.symbols[inner] = codes + 1
        order = self._suffixes(text)
        bwt = self.symbols[order - 1]
        counts = np.bincount(self.symbols, minlength=len(self.alphabet) + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])  # rows whose suffix starts with a smaller symbol
        self.levels: list[tuple[int, Bits, int]] = []
        row = bwt
        for shift in range(int(len(self.alphabet)).bit_length() - 1, -1, -1):
            bits = (row >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bits), n - int(bits.sum())))
            row = np.concatenate([row[~bits], row[bits]])
        self.size = n
        every = np.arange(len(self.alphabet) + 1)
        self.base = self._descend(every, np.zeros(len(every), np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling; ends as soon as all ranks differ."""
        n, width = len(text), 1
        rank = text
        while True:
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            if fresh[order[-1]] == n - 1:
                return order
            rank, width = fresh, width * 2

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: rows of symbol followed by what the rows low..high-1 start with."""
        both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) - np.tile(self.base[symbol], 2) + np.tile(self.less[symbol], 2)
        return both[: len(low)], both[len(low) :]

    def repeated_windows(self, windows: np.ndarray, length: int, piece: int = 6) -> list[list[int]]:
        """For each segment, which has windows[i] windows of length symbols: [first, last, ...] of the runs of window starts that occur at least twice in the text.

        Matching statistics from right to left, all segments in step. A window is first probed by a
        short piece at its start, and one that failed by a short piece where it failed: if such a piece
        occurs once, no window around it repeats. A window that matched is extended to the left as long
        as the match still occurs twice.
        """
        n, piece = len(windows), min(piece, length)
        runs: list[list[int]] = [[] for _ in range(n)]
        s = windows.astype(np.int64) - 1  # the window in question; below 0: the segment is done
        mode = np.zeros(n, np.int8)  # PROBE, WHOLE, AFTER
        probe, whole, after = 0, 1, 2
        least, at = s.copy(), s + piece  # what is matched so far starts at `at`; a piece is matched down to `least`
        low, high = np.zeros(n, np.int64), np.full(n, self.size, np.int64)

        def begin(k: np.ndarray, how: int, start: np.ndarray, end: np.ndarray) -> None:
            mode[k], least[k], at[k], low[k], high[k] = how, start, end, 0, self.size

        end = at.copy()
        live = np.flatnonzero(s >= 0)
        while len(live):
            left = at[live] == 0
            k = live[~left]
            low[k], high[k] = self.extend(self.symbols[self.starts[k] + at[k] - 1], low[k], high[k])
            at[k] -= 1
            single = np.zeros(n, bool)
            single[k] = high[k] - low[k] < 2
            ended = np.zeros(n, bool)
            ended[live[left]] = True
            m = mode[live]
            pieces = live[m != whole]
            failed = pieces[single[pieces]]
            passed = pieces[~single[pieces] & (at[pieces] == least[pieces])]
            stop = live[m == whole]
            stop = stop[single[stop] | ended[stop]]
            s[failed] = end[failed] - length - 1
            first = at[stop] + single[stop]  # the longest match that ends with the window
            hit = first <= s[stop]
            for i, a, b in zip(stop[hit].tolist(), first[hit].tolist(), s[stop[hit]].tolist(), strict=True):
                runs[i] += [a, b]
            s[stop[hit]] = first[hit] - 1
            common = passed[mode[passed] == after]
            s[common] -= 1
            fresh = np.concatenate([failed, stop[hit], common])
            end[fresh] = s[fresh] + piece
            begin(fresh, probe, s[fresh], end[fresh])
            ready = passed[mode[passed] == probe]
            ready = np.setdiff1d(ready, fresh, assume_unique=True)
            end[ready] = s[ready] + length
            begin(ready, whole, s[ready], end[ready])
            miss = stop[~hit]
            start = np.minimum(at[miss], s[miss] + length - piece)
            end[miss] = start + piece
            begin(miss, after, start, end[miss])
            live = live[s[live] >= 0]
        return runs
