"""Ids of whole texts by the ``tokenizers`` library, asked once per distinct piece.

The vocabulary drops white space and never merges over it, so a text's ids are those of
its pieces in order.  So is a piece's that is cut between an ASCII letter or digit and the
punctuation after it.  Pieces are cut, hashed and looked up as arrays, a batch of texts at
a time, in a bounded table of this worker; only pieces that are new go to the library.
Pieces of ASCII letters are known by their lower case and go there many to a text, other
pieces as strings.
"""

from __future__ import annotations

import unicodedata
from itertools import compress

import numpy as np
import pyarrow as pa

from .common import text_bytes
from .words import word_hashes, word_spans

SLOTS = 1 << 20     # of the table; three quarters of them are used at most
WORDS = 150_000     # folded words remembered
_MARKS = frozenset(".,;:!?")


def _bytes_of(*ranges: str) -> np.ndarray:
    """A table of the bytes in some ranges, each given by its ends."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[ord(a):ord(b) + 1] = True
    return table


_LETTER = _bytes_of("az", "AZ")
# Where a piece is cut; the bar is left out, because the vocabulary's special tokens hold it after letters.
_CUT = (_bytes_of("az", "AZ", "09"), _bytes_of("!/", ":@", "[`", "{{", "}~"))
_OTHER = ~(_LETTER | _bytes_of("\t\r", "  "))
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A"):ord("Z") + 1] += 32


class WordIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Lower-case ASCII letters between blanks need no normaliser and no pattern.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(1 << 16, bool)  # the tokens that end a short word
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = {m: np.array([vocabulary[m + "</w>"]], "<u2").tobytes() for m in _MARKS}
        self.words: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)      # hash of the piece in each slot; 0: free
        self.entry = np.zeros(SLOTS, np.int32)      # its number
        self.ids = np.zeros(1 << 16, "<u2")         # the ids of all pieces, one after another
        self.ends = np.zeros(1, np.int64)           # where each piece's ids end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's begin (one more
        entry than texts)."""
        raw, offsets = text_bytes(texts)
        starts, ends, firsts = word_spans(raw, offsets, cut=_CUT)
        plain = np.zeros(0, bool)  # whether a piece has ASCII letters only
        if len(starts):
            plain = ~np.logical_or.reduceat(_OTHER[raw], starts)
        hashes = np.empty(len(starts), np.uint64)
        for some, lower in ((plain, True), (~plain, False)):
            hashes[some] = word_hashes(raw, starts[some], ends[some], lower)
        hashes = np.maximum(hashes, np.uint64(1))
        ids, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for lo in range(0, len(hashes), SLOTS // 4):  # the table holds the pieces of a part
            part = slice(lo, lo + SLOTS // 4)
            number = self._numbers(hashes[part], raw, starts[part], ends[part], plain[part])
            begin = self.ends[number]
            size = self.ends[number + 1] - begin
            total = np.cumsum(size)
            ids.append(self.ids[np.arange(total[-1]) + np.repeat(begin - total + size, size)])
            sizes.append(size)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(ids), bounds[firsts]

    def _numbers(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                 plain: np.ndarray) -> np.ndarray:
        """The number of each piece; new pieces are entered first."""
        number = self._find(hashes)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            at = missing[np.unique(hashes[missing], return_index=True)[1]]
            if len(self.ends) + len(at) > SLOTS // 2:
                self._clear()
                at = np.unique(hashes, return_index=True)[1]
                missing = np.arange(len(hashes))
            for ask, at in ((self._letters, at[plain[at]]), (self._mixed, at[~plain[at]])):
                if len(at):
                    self._add(hashes[at], *ask(raw, starts[at], ends[at]))
            number[missing] = self._find(hashes[missing])
        return number

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, -1 if it isn't there."""
        mask = np.uint64(SLOTS - 1)
        slot = (hashes & mask).astype(np.int64)
        key = self.keys[slot]
        number = np.where(key == hashes, self.entry[slot], -1)
        todo = np.flatnonzero((key != hashes) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            key = self.keys[slot[todo]]
            hit = key == hashes[todo]
            number[todo[hit]] = self.entry[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return number

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Enter new pieces (distinct hashes) with their ids."""
        used, first = int(self.ends[-1]), len(self.ends) - 1
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u2")])
        self.ids[used:used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])
        slot, todo = (hashes & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]] = hashes[placed]
            self.entry[slot[placed]] = first + placed
            todo = todo[self.keys[slot[todo]] != hashes[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _letters(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of new pieces of ASCII letters, many to a text."""
        lengths = ends - starts
        stops = np.cumsum(lengths + 1)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined = np.full(stops[-1], 0x20, np.uint8)
        joined[place + np.repeat(stops - lengths - 1, lengths)] = _FOLDED[raw[place + np.repeat(starts, lengths)]]
        text, cuts = joined.tobytes().decode("ascii"), [0, *stops[127:-1:128].tolist(), int(stops[-1])]
        ids = self._ids(self.letters, [text[a:b] for a, b in zip(cuts, cuts[1:])])
        return ids, np.diff(np.flatnonzero(self.final[ids]), prepend=-1)

    def _mixed(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of other new pieces."""
        pieces = [raw[a:b].tobytes().decode("utf-8") for a, b in zip(starts, ends)]
        found = self._new(pieces)
        blobs = [found[p] for p in pieces]
        return np.frombuffer(b"".join(blobs), "<u2"), np.array([len(b) // 2 for b in blobs], np.int64)

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces.  Letters, and letters before one mark, share the memory of
        folded words; the rest goes to the library piece by piece."""
        joined = " ".join(pieces)
        if unicodedata.is_normalized("NFC", joined):
            # Lower case letter by letter, as the vocabulary's normaliser does it.
            folded = joined.replace("Σ", "σ").lower().split(" ")
            words = [f[:-1] if f[-1] in _MARKS else f for f in folded]
            plain = list(map(str.isalpha, words))
        else:
            folded = words = pieces
            plain = [False] * len(pieces)
        if len(self.words) > WORDS:
            self.words.clear()
        known, marks = self.words, self.marks
        self._learn(list(set(compress(words, plain)).difference(known)))
        found = {p: known[w] if len(w) == len(f) else known[w] + marks[f[-1]]
                 for p, f, w, good in zip(pieces, folded, words, plain) if good}
        other = [p for p, good in zip(pieces, plain) if not good]
        if other:
            encoded = self.tokenizer.encode(other, is_pretokenized=True, add_special_tokens=False)
            places = np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(len(other) + 1)) * 2
            found.update(self._cut(other, np.array(encoded.ids, "<u2"), places.tolist()))
        return found

    def _learn(self, words: list[str]) -> None:
        """Many words share one text: each is ended by a final token."""
        texts = [" ".join(words[i:i + 128]) for i in range(0, len(words), 128)]
        ids = self._ids(self.tokenizer, texts)
        self.words.update(self._cut(words, ids, [0, *(2 * (np.flatnonzero(self.final[ids]) + 1)).tolist()]))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> np.ndarray:
        encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.array([i for x in encoded for i in x.ids], "<u2")

    @staticmethod
    def _cut(pieces: list[str], ids: np.ndarray, ends: list[int]):
        return zip(pieces, map(ids.tobytes().__getitem__, map(slice, ends, ends[1:])))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
