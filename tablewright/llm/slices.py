"""Slices of a byte string told apart without an object for each."""

from __future__ import annotations

import numpy as np

EXACT = 16  # bytes; slices up to this length are compared as two 64-bit numbers, longer ones stand for themselves
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def _windows(data: bytes) -> np.ndarray:
    """The eight bytes from every byte on, as one number; zeros behind the end."""
    n = len(data)
    padded = data + bytes(32 - n % 8)
    out = np.empty(n + 16, np.uint64)
    for k in range(8):
        here = out[k::8]
        here[:] = np.frombuffer(padded, "<u8", count=len(here), offset=k)
    return out


def distinct(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(indices of slices, at least one for each distinct content; for every slice the place of its equal among them; keys).

    The keys belong to the leading slices, all of up to ``EXACT`` bytes: a mixture by which they are sorted, and the
    content as two numbers and a size.  Equal numbers are found by sorting a mixture of them and then compared themselves, so what shares a mixture only
    by chance stays apart.
    """
    size = (last - first).astype(np.int64)
    short = np.flatnonzero(size <= EXACT)
    at, n = first[short], size[short]
    windows = _windows(data)
    low = windows[at] & MASKS[np.minimum(n, 8)]
    high = windows[at + 8] & MASKS[np.maximum(n - 8, 0)]
    mixed = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    order = np.argsort(mixed)
    in_order = mixed[order]
    new = np.ones(len(order), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    told = np.empty(len(order), np.int64)
    told[order] = np.cumsum(new) - 1
    found = order[new]
    other = found[told]
    alone = np.flatnonzero((low[other] != low) | (high[other] != high) | (n[other] != n))
    places = np.empty(len(size), np.int64)
    places[short] = told
    rest = np.concatenate([short[alone], np.flatnonzero(size > EXACT)])
    places[rest] = len(found) + np.arange(len(rest))
    return np.concatenate([short[found], rest]), places, (mixed[found], low[found], high[found], n[found].astype(np.int8))


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of list ``places[0]``, of ``places[1]`` and so on; their sizes), for lists that lie in ``values`` from ``starts`` on."""
    n = sizes[places]
    before = np.cumsum(n) - n
    return values[np.repeat(starts[places] - before, n) + np.arange(int(n.sum()))], n


class Memory:
    """Lists of numbers by the keys of :func:`distinct`, in sorted arrays: no object for each.

    ``most`` entries are held twice: when the younger half is full it becomes the older one, and the older one
    before is given up.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, [], []

    def find(self, keys: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(indices of the keys found, the numbers of their lists one after the other, the sizes of the lists)."""
        todo = np.arange(len(keys[0]))
        at, values, sizes = [todo[:0]], [np.zeros(0, np.int32)], [todo[:0]]
        for *told, starts, counts, ids in (*self.young, *self.old):
            place = np.minimum(np.searchsorted(told[0], keys[0][todo]), len(starts) - 1)
            hit = np.ones(len(todo), bool)
            for mine, asked in zip(told, keys):
                hit &= mine[place] == asked[todo]
            v, n = spread(ids, starts, counts, place[hit])
            at.append(todo[hit]), values.append(v), sizes.append(n)
            todo = todo[~hit]
        return np.concatenate(at), np.concatenate(values), np.concatenate(sizes)

    def add(self, keys: tuple[np.ndarray, ...], values: np.ndarray, sizes: np.ndarray) -> None:
        """Lists for keys that were not found, in the order of their keys."""
        if not len(sizes):
            return
        if sum(len(run[0]) for run in self.young) >= self.most:
            self.old, self.young = self.young, []
        new = (*keys, (np.cumsum(sizes) - sizes).astype(np.int32), sizes.astype(np.int32), values.astype(np.int32))
        while self.young and len(self.young[-1][0]) <= 2 * len(new[0]):
            new = self._merged(self.young.pop(), new)
        self.young.append(new)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate([x, y]) for x, y in zip(a, b)]
        order = np.argsort(both[0], kind="stable")
        starts = np.concatenate([a[-3], b[-3] + np.int32(len(a[-1]))])[order]
        return (*(c[order] for c in both[:-3]), starts, both[-2][order], both[-1])


def told(data: bytes, first: np.ndarray, last: np.ndarray, memory: Memory, ask) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all slices, the size of each list): from the memory, or from ``ask``, which gets the slices not in it.

    ``ask`` returns (numbers of all its slices, sizes).
    """
    which, places, keys = distinct(data, first, last)
    met, values, sizes = memory.find(keys)
    missed = np.ones(len(which), bool)
    missed[met] = False
    missed = np.flatnonzero(missed)
    new, counts = ask([data[a:b] for a, b in zip(first[which[missed]].tolist(), last[which[missed]].tolist())])
    short = int(np.searchsorted(missed, len(keys[0])))  # the missed ones that have a key come first
    memory.add(tuple(k[missed[:short]] for k in keys), new[: int(counts[:short].sum())], counts[:short])
    order = np.concatenate([met, missed])
    length = np.empty(len(which), np.int64)
    length[order] = np.concatenate([sizes, counts])
    start = np.empty(len(which), np.int64)
    start[order] = np.cumsum(length[order]) - length[order]
    return spread(np.concatenate([values, new]), start, length, places)
