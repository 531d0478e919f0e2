"""Word boundaries and word hashes of whole Arrow columns, in numpy.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return; those are single bytes in UTF-8, so words never split a character.  A
hash is 64 bits wide and depends on the word alone.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE = 1 << 20  # bytes hashed at a time

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        grown = np.full(max(n, 2 * len(_POWERS)), _STEP, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    elif _POWERS[1] == 1:
        seeded = np.full(64, _STEP, np.uint64)
        seeded[0] = 1
        _POWERS = np.multiply.accumulate(seeded)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letter_breaks() -> np.ndarray:
    """Breaks at every ASCII byte that is no letter or digit: words without punctuation."""
    table = np.ones(256, bool)
    table[128:] = False
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        table[ord(a):ord(b) + 1] = False
    return table


def word_spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE,
               cut: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of the first word of each row
    (one more entry than rows).  ``cut``: words also end after a byte of the first table
    that one of the second follows."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~breaks[raw]
    apart = ~word
    first = word.copy()
    first[1:] &= apart[:-1] if cut is None else apart[:-1] | cut[0][raw[:-1]] & cut[1][raw[1:]]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    first[edges] = word[edges]
    last = word
    keep = word[edges - 1].copy()
    last[:-1] &= apart[1:] if cut is None else apart[1:] | first[1:]
    last[edges - 1] = keep
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z to a-z first."""
    out = np.empty(len(starts), np.uint64)
    values = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        s, e = starts[i:j], ends[i:j]
        lengths = e - s
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = place + np.repeat(s, lengths)
        terms = values[raw[at]]
        terms *= _powers(int(lengths.max()))[place]
        out[i:j] = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        i = j
    return mix(out)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of every k consecutive words (rows are not told apart)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, k):
        total *= _STEP
        total += hashes[i:i + n]
    return mix(total)


def run_mask(firsts: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which of the ``n_words - k + 1`` runs of :func:`runs` stay within one row."""
    n = max(0, n_words - k + 1)
    ok = np.ones(n, bool)
    inner = firsts[1:-1]
    # a run that starts in the k-1 words before a later row's first word crosses a boundary
    cross = np.zeros(n_words + 1, np.int32)
    inner = inner[(inner > 0) & (inner < n_words)]
    np.add.at(cross, np.maximum(inner - k + 1, 0), 1)
    np.add.at(cross, inner, -1)
    return ok & (np.cumsum(cross)[:n] == 0)
