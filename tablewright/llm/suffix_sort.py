"""Deep-shallow suffix sorting of the windows of a shard.

Multikey quicksort orders the windows by their first bytes, eight at a time,
and only inside groups that are still equal; at a shallow depth the remaining
groups share a long prefix, and a blind trie orders each of them.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 64  # bytes


class BlindTrie:
    """Distinct strings of one length; an inner node holds the place where its strings first differ.

    An insertion walks down by single bytes, without looking at those between,
    compares with the one string it arrives at, and splits the edge at the first difference.
    """

    def __init__(self, first: bytes, item: int):
        self.root: list = [len(first), first, [item]]  # leaf: [length, string, items]

    def insert(self, string: bytes, item: int) -> None:
        node, path = self.root, []
        while len(node) == 2:  # inner: [place, children]
            path.append(node)
            children = node[1]
            node = children.get(string[node[0]]) or next(iter(children.values()))
        if node[1] == string:
            node[2].append(item)
            return
        other = node[1]
        x = int.from_bytes(string, "big") ^ int.from_bytes(other, "big")
        place = len(string) - 1 - (x.bit_length() - 1) // 8
        leaf = [len(string), string, [item]]
        above = None
        for inner in path:
            if inner[0] >= place:
                break
            above = inner
        below = self.root if above is None else above[1][other[above[0]]]
        if len(below) == 2 and below[0] == place:
            below[1][string[place]] = leaf
            return
        split = [place, {other[place]: below, string[place]: leaf}]
        if above is None:
            self.root = split
        else:
            above[1][other[above[0]]] = split

    def groups(self):
        """Items of equal strings, in the order of the strings."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                yield node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def sorted_groups(text: bytes, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their windows of ``width`` bytes, and the number of the group of equal windows of each."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    order = np.asarray(places, np.int64)
    group = np.zeros(len(order), np.int64)
    shallow = min(SHALLOW, width) // 8 * 8
    open_ = np.arange(len(order))  # those in groups of two or more
    for depth in range(0, shallow, 8):
        if not len(open_):
            break
        word = np.zeros(len(open_), np.uint64)
        for j in range(8):
            word = word << np.uint64(8) | data[order[open_] + depth + j].astype(np.uint64)
        by = np.lexsort((word, group[open_]))
        order[open_] = order[open_][by]
        word, inside = word[by], group[open_]  # the group numbers are ascending already
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])))
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]  # a group is named by its first place
        alone = new & np.concatenate((new[1:], [True]))
        open_ = open_[~alone]
    if shallow < width and len(open_):
        inside = group[open_]
        starts = np.flatnonzero(np.concatenate(([True], inside[1:] != inside[:-1])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(open_)]):
            members = order[open_[a:b]].tolist()
            trie = BlindTrie(text[members[0] + shallow : members[0] + width], members[0])
            for m in members[1:]:
                trie.insert(text[m + shallow : m + width], m)
            at = int(open_[a])
            for equal in trie.groups():
                order[at : at + len(equal)] = equal
                group[at : at + len(equal)] = at
                at += len(equal)
    return order, group


def later_windows(contents: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content, from, to): runs of windows that an earlier content holds too; contents are in the order of their first places."""
    from tablewright.llm.fm_index import runs

    sizes = np.array([len(c) for c in contents])
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows = np.maximum(0, sizes - width + 1)
    at = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    order, group = sorted_groups(b"".join(contents), at, width)
    size = int(sizes.sum())
    first = np.full(len(order), size)
    np.minimum.at(first, group, order)  # contents are laid out in order, so the smallest place is the earliest
    on = np.zeros(size + 1, bool)
    on[order[order != first[group]]] = True
    return runs(on, begins)
