"""Token counts of whole texts by a byte-level vocabulary, with a map-side two-tier lookup.

A text's number of tokens is the sum over its pre-tokens, and most of a corpus consists of
few different pre-tokens.  First tier: a compact hash table (hash of the pre-token, number
of its tokens) of the frequent ones is broadcast to all tasks.  Second tier: what it
misses is looked up in a larger table of the Python worker, which lives on from task to
task; only what is new there is encoded by the library.  Pre-tokens are cut, hashed,
looked up and summed as arrays.  No pre-token and no text is shuffled.

The first tier comes from a census of all documents in a pass of its own: each task sends its
different pre-tokens as (hash, count, tokens), the counts are summed by hash, and a histogram
of them (``STEPS`` steps for each doubling) tells from which count on at most ``FREQUENT``
are left: those are the table.  It decides which tier answers, never a count.

Defined results: a null or empty text has no bytes and no tokens; rows with a null id are
returned with their null id; repeated rows are each counted; an empty table gives no rows.
The string of a special token inside a text is one token, as the library takes it.  A text
of any length is counted whole, ``PIECE`` bytes at a time (cut where white space follows a
word).  Pre-tokens are told apart by 64-bit hashes; those over ``LONGEST`` bytes are encoded
where they stand and not remembered.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, discard, ready, staged, text_bytes
from .pretokens import safe_cuts, starts
from .words import word_hashes

FREQUENT = 1 << 16
STEPS = 16
HELD = 1 << 20
PIECE = 1 << 20
SLOTS = 1 << 21
LONGEST = 256
LIMIT = 512

_COUNTS = "doc_id long, n_bytes long, n_tokens long"


class Lengths:
    """An open hash table of arrays: 64-bit keys (0: free) and token numbers."""

    def __init__(self, slots: int):
        self.slots, self.used = slots, 0
        self.keys = np.zeros(slots, np.uint64)
        self.values = np.zeros(slots, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The token number of each hash, -1 where it isn't known."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        key = self.keys[slot]
        found = np.where(key == hashes, self.values[slot].astype(np.int32), np.int32(-1))
        todo = np.flatnonzero((key != hashes) & (key != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
            key = self.keys[slot[todo]]
            hit = key == hashes[todo]
            found[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (key != 0)]
        return found

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Enter new, distinct hashes.  A table three quarters full starts again."""
        if self.used + len(hashes) > self.slots * 3 // 4:
            self.keys[:], self.used = 0, 0
            hashes, values = hashes[:self.slots // 2], values[:self.slots // 2]
        self.used += len(hashes)
        slot, todo = (hashes & np.uint64(self.slots - 1)).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.keys[slot[placed]] = hashes[placed]
            self.values[slot[placed]] = values[placed]
            todo = todo[self.keys[slot[todo]] != hashes[todo]]
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)


class TokenCounter:
    """Counts tokens of Arrow columns; lives as long as the Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        self.cache = Lengths(SLOTS)

    def specials(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of special tokens begin and end; the first one wins."""
        text, found = raw.tobytes(), []
        at = 0
        while True:
            hits = [(i, -len(s)) for s in self.special if (i := text.find(s, at)) >= 0]
            if not hits:
                break
            i, size = min(hits)
            found.append((i, i - size))
            at = i - size
        places = np.array(found, np.int64).reshape(-1, 2)
        return places[:, 0], places[:, 1]

    def cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pre-tokens, and which of them are special tokens."""
        begin, end = self.specials(raw)
        # A special string over the edge of two texts is none.
        row = np.searchsorted(offsets, begin, "right")
        inside = offsets[np.minimum(row, len(offsets) - 1)] >= end
        begin, end = begin[inside], end[inside]
        first = starts(raw, np.unique(np.concatenate([offsets[:-1], begin, end])))
        which = np.searchsorted(begin, first, "right") - 1
        covered = (which >= 0) & (first < np.append(end, 0)[which])
        head = covered & (first == np.append(begin, 0)[which])
        keep = ~covered | head
        first, head = first[keep], head[keep]
        return first, np.append(first[1:], len(raw)), head

    def pieces(self, raw: np.ndarray, offsets: np.ndarray, frequent: Lengths | None):
        """(start of each pre-token, its tokens) for the bytes of some texts."""
        first, end, special = self.cut(raw, offsets)
        if not len(first):
            return first, np.zeros(0, np.int32)
        hashes = np.maximum(word_hashes(raw, first, end), np.uint64(1))
        count = np.full(len(first), -1, np.int32) if frequent is None else frequent.find(hashes)
        count[special] = 1
        miss = np.flatnonzero(count < 0)
        if len(miss):
            new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            count[miss] = self.lengths(raw, first[miss[at]], end[miss[at]], new)[back]
        return first, count

    def lengths(self, raw: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The tokens of different pre-tokens by the worker's table; new ones are entered."""
        value = self.cache.find(hashes)
        unknown = np.flatnonzero(value < 0)
        if len(unknown):
            a, b = first[unknown], end[unknown]
            value[unknown] = self.encode([raw[i:j].tobytes().decode("utf-8") for i, j in zip(a, b)])
            short = unknown[b - a <= LONGEST]
            self.cache.add(hashes[short], value[short].astype(np.uint16))
        return value

    def census(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different pre-tokens of some texts: hashes, how often each occurs, its tokens."""
        first, end, special = self.cut(raw, offsets)
        fits = ~special & (end - first <= LONGEST)
        first, end = first[fits], end[fits]
        if not len(first):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        hashes = np.maximum(word_hashes(raw, first, end), np.uint64(1))
        key, at, times = np.unique(hashes, return_index=True, return_counts=True)
        return key, times, self.lengths(raw, first[at], end[at], key)

    def encode(self, pieces: list[str]) -> np.ndarray:
        """The library's token number of each pre-token."""
        encoded = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(pieces))

    def parts(self, column: pa.Array):
        """The bytes of a column's texts in parts of about ``PIECE`` bytes: for each the
        bytes, where texts begin in it (and its end), and the number of its first text."""
        raw, offsets = text_bytes(column)
        edges = [offsets]
        sizes = np.diff(offsets)
        for row in np.flatnonzero(sizes > PIECE):
            edges.append(offsets[row] + safe_cuts(raw[offsets[row]:offsets[row + 1]], PIECE))
        edges = np.unique(np.concatenate(edges))
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + PIECE, "right")) - 1)
            yield raw[edges[i]:edges[j]], edges[i:j + 1] - edges[i], int(edges[i])
            i = j

    def count(self, column: pa.Array, frequent: Lengths | None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of each text."""
        offsets = text_bytes(column)[1]
        n_bytes, n_tokens = np.diff(offsets), np.zeros(len(column), np.int64)
        for raw, inner, base in self.parts(column):
            first, count = self.pieces(raw, inner, frequent)
            row = np.searchsorted(offsets, first + base, "right") - 1
            n_tokens += np.bincount(row, count, len(column)).astype(np.int64)
        return n_bytes, n_tokens


_LOADED: dict[str, TokenCounter] = {}


def loaded(path: str) -> TokenCounter:
    if path not in _LOADED:
        _LOADED[path] = TokenCounter(path)
    return _LOADED[path]


def summed(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several :meth:`TokenCounter.census` as one."""
    keys, times, tokens = (np.concatenate(c) for c in zip(*found))
    key, at, back = np.unique(keys, return_index=True, return_inverse=True)
    return key, np.bincount(back, times, len(key)).astype(np.int64), tokens[at]


def frequent_lengths(docs: DataFrame, path: str) -> Lengths | None:
    """The first tier, from the pre-tokens of all documents; None if there are none."""
    def census(batches):
        counter, found, held = loaded(path), [], 0
        for rows in batches:
            for raw, offsets, _ in counter.parts(rows.column(0)):
                found.append(counter.census(raw, offsets))
                held += len(found[-1][0])
                if held >= HELD:
                    found = [summed(found)]
                    held = len(found[0][0])
                if held >= HELD // 2 and len(found) == 1:  # most are different: what follows has room again
                    yield batch(key=found[0][0].view(np.int64), times=found[0][1], tokens=found[0][2].astype(np.int32))
                    found, held = [], 0
        if found:
            key, times, tokens = summed(found)
            yield batch(key=key.view(np.int64), times=times, tokens=tokens.astype(np.int32))

    counted = staged(docs.select("text").mapInArrow(census, "key long, times long, tokens int").groupBy("key").agg(
        F.sum("times").alias("times"), F.max("tokens").alias("tokens")).select(
        "key", "tokens", F.floor(F.log2("times") * STEPS).alias("step")), "census")
    left, least = FREQUENT, None
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most 64 * STEPS rows
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    found = counted.filter(F.col("step") >= least).select("key", "tokens").toArrow() if least is not None else None
    discard(counted)
    if found is None:
        return None
    table = Lengths(4 * FREQUENT)
    table.add(found["key"].to_numpy().view(np.uint64), found["tokens"].to_numpy().astype(np.uint16))
    return table


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every document.  ``path``: the vocabulary
    file on driver and executors."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast(frequent_lengths(texts, path))

    def run(batches):
        counter = loaded(path)
        for rows in batches:
            n_bytes, n_tokens = counter.count(rows.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_bytes), pa.array(n_tokens)],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    return texts.mapInArrow(run, _COUNTS)


def with_limit(counts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The counts, and whether a document has more than ``limit`` tokens."""
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
