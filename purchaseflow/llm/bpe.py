"""BPE encoding and decoding of whole texts with a public word-level BPE vocabulary.

A text is split at its white space; what each piece becomes depends on the piece alone,
so pieces are remembered per Python worker in a bounded memory.  A new piece is
normalised (NFC, lower case), cut into short words by the vocabulary's pattern, and each
short word is merged over a contiguous rank array: the part boundaries and the rank of
every adjacent pair are held in two lists, the minimum is found by a scan, its boundary
is deleted and the two neighbouring ranks are refreshed.

Defined results: null and empty texts give no ids and an empty decoded text; rows with a
null id take no part; repeated rows are each encoded; an empty table gives no rows.  A text of any length is encoded as
a whole; the memory holds at most ``MEMORY`` pieces and pieces over ``LONGEST`` characters
are not remembered.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, ready
from .unicode_classes import LETTER, NUMBER, ranges

MEMORY = 400_000
LONGEST = 64
NO_RANK = 1 << 30

# Fixed values of the vocabulary file format: the contractions of its pattern, its two
# special tokens and the mark of a word's end.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"


def unicode_class(kind: int) -> str:
    """The characters of a class as ranges of a pattern class."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges(kind))


@cache
def word_pattern() -> re.Pattern:
    """Contractions, runs of letters, single digits, runs of anything else but space."""
    letters, numbers = unicode_class(LETTER), unicode_class(NUMBER)
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|(?:[^\\s{letters}{numbers}]|[\x1c-\x1f])+")


@cache
def _normaliser():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


_SPECIALS = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")
# Python takes these for white space, the vocabulary's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
_PIECES = re.compile(r"(?:[^\s]|[\x1c-\x1f])+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others
    for the letters from 256 on, in ascending order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + WORD_END] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.words: dict[str, list[int]] = {}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def merge(self, word: str) -> list[int]:
        """The ids of one short word by repeated minimum scans over its rank array."""
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        rank_of = self.ranks.get
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            parts[at] = self.merged[low]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 20 | parts[at + 1], NO_RANK)
        return parts

    def _plain(self, piece: str) -> list[int]:
        if piece.isascii() or not any(unicodedata.category(c) == "Cn" for c in piece):
            text = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        else:  # newer than Python's tables: the library's form of it
            text = _normaliser().normalize_str(piece)
        ids: list[int] = []
        for word in word_pattern().findall(text):
            known = self.words.get(word)
            if known is None:
                known = self.merge(word)
                if len(word) <= LONGEST:
                    if len(self.words) >= MEMORY:
                        self.words.clear()
                    self.words[word] = known
            ids += known
        return ids

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids (16-bit, little-endian) and decoded text of a run without white space."""
        if "<|" in piece:
            ids = []
            for part in _SPECIALS.split(piece):
                ids += [self.special[part]] if part in self.special else self._plain(part)
        else:
            ids = self._plain(piece)
        tokens = self.tokens
        found = np.array(ids, "<u2").tobytes(), " ".join([tokens[i] for i in ids])
        if len(piece) <= LONGEST:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids (16-bit, little-endian) and decoded text of a whole text."""
        pieces = _PIECES.findall(text) if _ODD.search(text) else text.split()
        known, new = self.pieces.get, self.piece
        found = [known(p) or new(p) for p in pieces]
        return b"".join([x for x, _ in found]), " ".join([x for _, x in found])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of every
    text.  ``path`` names the vocabulary file on the executors."""
    ready(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for rows in batches:
            for at in range(0, rows.num_rows, 256):  # bounded output batches
                part = rows.slice(at, 256)
                found = [bpe.encode(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0),
                     pa.array([np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, _ in found], pa.binary()),
                     pa.array([x for _, x in found], pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def token_digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of :func:`encode_documents`."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
