"""Classes of all code points as the tokenizers library sees them.

The running Python knows the classes of the characters of its own Unicode version; the
library may know newer ones.  So characters that Python has no category for are shown to
the library's own pattern engine, and its answer is taken.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)

#: Characters are assigned in the first four planes and in the fifteenth.
_PLANES = (*range(0x40000), *range(0xE0000, 0xF0000))
_POINTS = 0x110000


@cache
def class_table() -> np.ndarray:
    """The class of every code point (surrogates: OTHER)."""
    from tokenizers import Regex, pre_tokenizers

    table = np.zeros(_POINTS, np.uint8)
    category = np.array([unicodedata.category(chr(c)) for c in range(_POINTS)])
    table[np.char.startswith(category, "L")] = LETTER
    table[np.char.startswith(category, "N")] = NUMBER
    new = np.array([c for c in _PLANES if category[c] == "Cn"], np.uint32)
    text = new.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[new[a:b]] = kind
    # Python also calls four control characters white space; patterns don't.
    table[[c for c in range(_POINTS) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = SPACE
    return table


def ranges(kind: int) -> list[tuple[int, int]]:
    """First and last code point of every run of one class."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (class_table() == kind).view(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
