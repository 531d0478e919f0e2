"""Pre-tokens of a byte-level vocabulary, cut from the bytes of many texts as arrays.

The vocabulary's pattern takes, at each place, the first of: a contraction; an optional
space and a run of letters; the same of digits; the same of anything else but white
space; white space up to the last one before a word; white space.  Read as boundaries:

* a pre-token begins where the class of a character differs from the one before;
* the last white space of a run that a word follows begins one too, and if it is a
  space the word joins it;
* a contraction that begins a pre-token ends after its letters.
"""

from __future__ import annotations

import numpy as np

from .unicode_classes import SPACE, class_table

# Fixed values of the pattern: the letters of its contractions.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

_SPACE, _APOSTROPHE = 0x20, 0x27


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of all characters, and their code points."""
    if not (raw & 0x80).any():
        return np.arange(len(raw)), raw.astype(np.uint32)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[at]
    points = first.astype(np.uint32)
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        those = np.flatnonzero((first >= low) & (first < high))
        value = points[those] & mask
        for i in range(1, more + 1):
            value = value << 6 | (raw[at[those] + i] & 0x3F)
        points[those] = value
    return at, points


def starts(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Byte places where pre-tokens begin.  ``cuts`` are places where a text begins, in
    order; no pre-token crosses one."""
    if not len(raw):
        return np.zeros(0, np.int64)
    at, points = code_points(raw)
    kind = class_table()[points]
    n = len(at)
    fresh = np.zeros(n + 1, bool)  # a text begins here; the end counts too
    fresh[np.searchsorted(at, cuts[cuts < len(raw)])] = True
    fresh[[0, n]] = True
    begin = fresh[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # White space before a word.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~fresh[1:n])
    begin[last] = True
    begin[last[points[last] == _SPACE] + 1] = False
    # Contractions: an apostrophe that begins a pre-token, then one or two letters.
    mark = np.flatnonzero((points == _APOSTROPHE) & begin)
    mark = mark[(mark + 1 < n)]
    mark = mark[~fresh[mark + 1]]
    one = np.isin(points[mark + 1], [ord(c) for c in ONE_LETTER])
    after = np.minimum(mark + 2, n - 1)
    two = np.zeros(len(mark), bool)
    for a, b in TWO_LETTERS:
        two |= (points[mark + 1] == ord(a)) & (points[after] == ord(b))
    two &= (mark + 2 < n) & ~fresh[after]
    found = one | two
    begin[mark[found] + 1] = False
    end = mark[found] + np.where(one[found], 2, 3)
    begin[end[end < n]] = True
    return at[begin]


def safe_cuts(raw: np.ndarray, size: int) -> np.ndarray:
    """Places, some ``size`` bytes apart, where a long text can be cut without changing its
    pre-tokens: where ASCII white space follows something that is no white space."""
    if len(raw) <= size:
        return np.zeros(0, np.int64)
    blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    word = ((raw >= 0x30) & (raw <= 0x39)) | ((raw >= 0x41) & (raw <= 0x5A)) | ((raw >= 0x61) & (raw <= 0x7A))
    ok = np.flatnonzero(blank[1:] & word[:-1]) + 1
    wanted = np.searchsorted(ok, np.arange(size, len(raw), size))
    return np.unique(ok[wanted[wanted < len(ok)]])
