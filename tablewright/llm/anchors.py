"""Windows of a text dealt out by content.

All windows of ``width`` units (bytes or words) are cut into segments: runs of
neighbouring windows that share one minimizer, the place with the smallest hash
of ``gram`` units in the window (the leftmost of equal ones).  Equal windows have equal minimizers, wherever they
stand, so segments with equal anchors hold all windows that can be equal, and every
window is in one segment.  A segment is named by its anchor, its content, its start and its number of windows.

Short anchors stand in many texts by chance.  So a segment also has two longer keys: the anchor with the
units before it, which its earlier windows all hold, and with those after it, which its later windows hold.
A window can only stand elsewhere if the key of its half does.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tablewright.llm.rolling import U64, Ranges, window_min

SLICE = 1 << 21  # units handled at once; segments may be cut there, windows are not
PLACE_BITS = 24


class Segments(NamedTuple):
    text: np.ndarray  # number of the text
    start: np.ndarray  # first window, counted in units from the start of the text
    windows: np.ndarray
    anchor: np.ndarray  # signed 64-bit numbers
    content: np.ndarray
    before: np.ndarray  # key of the windows up to the middle; that of the others if there are none
    after: np.ndarray


def segments(values: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> Segments:
    """Segments of texts laid end to end: ``values`` has a 64-bit hash per unit, text i stands at bounds[i] … bounds[i+1]."""
    found = [_slice(values[a : a + SLICE + width - 1], bounds, a, width, gram) for a in range(0, max(1, len(values) - width + 1), SLICE)]
    return Segments(*(np.concatenate(columns) for columns in zip(*found)))


def _slice(values: np.ndarray, bounds: np.ndarray, offset: int, width: int, gram: int) -> Segments:
    n = len(values) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Segments(*[none] * 7)
    ranges = Ranges(values)
    at = np.arange(len(values) - gram + 1)
    grams = ranges.hashes(at, at + gram)
    low = U64((1 << PLACE_BITS) - 1)
    place = (window_min((grams & ~low) | at.astype(np.uint64), width - gram + 1) & low).astype(np.int64)
    text = np.searchsorted(bounds, np.arange(offset, offset + n), side="right") - 1
    whole = np.arange(offset + width, offset + n + width) <= bounds[text + 1]
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(begins)
    sizes = np.diff(np.append(first, n))
    keep = whole[first]
    first, sizes = first[keep], sizes[keep]
    half = (width - gram) // 2
    anchor, last = place[first], first + sizes - 1
    early, late = first <= anchor - half, last > anchor - half
    before = ranges.hashes(np.where(early, anchor - half, anchor), np.where(early, anchor + gram, anchor))
    after = ranges.hashes(anchor, np.where(late, anchor + width - half + 1, anchor))
    before, after = np.where(early, before, after), np.where(late, after, before)
    return Segments(
        text[first], first + offset - bounds[text[first]], sizes,
        grams[anchor].view(np.int64), ranges.hashes(first, first + sizes + width - 1).view(np.int64),
        before.view(np.int64), after.view(np.int64),
    )
