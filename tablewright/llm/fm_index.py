"""A compressed FM-index over the words of a shard, searched for many texts at once.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with one
running count per 64 of them.  Backward search extends the matches of all texts by one
word a step; a match that falls below two occurrences ends there, which gives the matching
statistics of the text from right to left, and the next search starts at the last word whose window is still open.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` words at least (prefix doubling)."""
    n, have = len(text), 1
    rank = text.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        if have < n:
            second[:-have] = rank[have:] + 1
        key = rank * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))) if n else 0
        have *= 2
        if have >= depth or n == 0 or rank[order[-1]] == n - 1:
            return order


class Wavelet:
    """Number of a symbol before a place, for arrays of symbols and places."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (text >> level & 1).astype(np.uint8)
            packed = np.zeros(len(text) // 64 * 8 + 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32))
            self.zeros.append(int(len(text) - bit.sum()))
            text = np.concatenate([text[bit == 0], text[bit == 1]])
        self.starts = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, words, counts, zeros in zip(range(self.levels - 1, -1, -1), self.words, self.counts, self.zeros):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(words[word] & below)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._down(symbol, place) - self.starts[symbol]


class FMIndex:
    """``weights`` of the suffixes: how often each place stands for an occurrence."""

    def __init__(self, text: np.ndarray, symbols: int, weights: np.ndarray, depth: int):
        order = suffix_array(text, depth)
        self.size = len(text)
        self.wavelet = Wavelet(text[order - 1], symbols)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.weight = np.concatenate(([0], np.cumsum(weights[order])))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.before[symbol] + both[: len(symbol)], self.before[symbol] + both[len(symbol) :]

    def occurrences(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight[high] - self.weight[low]


def repeated_windows(contents: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, from, to): runs of windows of ``width`` words that occur twice or more, for contents with the count 1.

    A content with a higher count is repeated as it is; it is in the index with its weight only.
    """
    split = [c.split(b" ") for c in contents]
    number: dict[bytes, int] = {}
    coded = [number.setdefault(w, len(number) + 1) for words in split for w in (*words, b"")]  # b"" ends a content
    symbols = len(number) + 1
    text = np.array(coded, np.int64)
    ends = np.cumsum([len(words) + 1 for words in split]) - 1  # places of the end marks
    begins = np.concatenate(([0], ends[:-1] + 1))
    weights = np.repeat(counts, ends - begins + 1)
    index = FMIndex(text, symbols, weights, width)

    marks = np.zeros(len(text) + 1, np.int64)
    alone = np.flatnonzero(counts == 1)
    begin, end = begins[alone], ends[alone].copy()
    low, high, length = np.zeros(len(alone), np.int64), np.full(len(alone), len(text)), np.zeros(len(alone), np.int64)
    live = end - begin >= width
    while live.any():
        begin, end, low, high, length = (x[live] for x in (begin, end, low, high, length))
        new_low, new_high = index.extend(text[end - length - 1], low, high)
        more = index.occurrences(new_low, new_high) > 1
        low, high, length = np.where(more, new_low, low), np.where(more, new_high, high), length + more
        over = ~more | (end - length == begin)
        wide = over & (length >= width)
        np.add.at(marks, (end - length)[wide], 1)
        np.add.at(marks, (end - width + 1)[wide], -1)
        # the window that begins at the word that did not fit, if the match was wide; else the one that ends one word before
        next_end = np.where(length >= width, end - length - 1 + width, end - 1)
        live = ~(over & more) & (~over | (next_end - begin >= width))
        end = np.where(over, next_end, end)
        low, high, length = np.where(over, 0, low), np.where(over, len(text), high), np.where(over, 0, length)
    return runs(np.cumsum(marks[:-1]) > 0, begins)


def runs(on: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set places as (content, from, to), counted from the content's begin."""
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    of = np.searchsorted(begins, first, side="right") - 1
    return of, first - begins[of], last - begins[of]
