"""Substring dedup: prefix-partitioned suffix trees over words.

A suffix is a word position with at least ``window`` words left in its document.  A
census counts the suffixes under every prefix of one, two, four and eight words (in hash
cells whose number follows the number of shuffle partitions).  A prefix with more than
``GROUP`` suffixes is extended to the next length, up to the window itself, so the
variable-length prefixes split the suffixes into groups that fit in memory.  A group's
subtree is kept at the depth that matters: suffixes are sorted by a digest of their first
``window`` words, and a run of equal digests is an internal node at that depth or below.
All leaves of such a node but its first (smallest ``doc_id``, then start) repeat an
earlier window; runs of such windows are the document's maximal repeats.

Copies within one batch of documents are settled there, so a passage shared by a third of
all documents sends one leaf a batch to its group.  What a group returns is dealt by
document and merged to spans; a document's text meets its spans in one join.

Defined results: a word is ``[^\\x20\\x09-\\x0D]+``, unchanged; null, empty and short texts
(under ``window`` words) keep all words; rows with a null id take no part; rows that
share an id are one document (same spans), also if repeated; an empty table gives no
rows; a text of any length is read whole, with the other texts of its batch.  Windows are compared by 56 bits of a hash, besides the hash of their prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, long_column, packed, ready, staged, text_bytes, trim, unpacked
from .words import mix, run_mask, runs, word_hashes, word_spans

WINDOW = 20
LEVELS = (1, 2, 4, 8)
GROUP = 1 << 20
CELLS = 1 << 16


def _suffixes(rows: pa.RecordBatch, window: int):
    """Word hashes of a batch, the first word of each row, and the suffix positions."""
    raw, offsets = text_bytes(rows.column(1))
    starts, ends, firsts = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends)
    return hashes, firsts, np.flatnonzero(run_mask(firsts, len(hashes), window))


def _prefix(hashes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    return mix(runs(hashes, words)[at])


def census(docs: DataFrame, window: int, cells: int) -> list[np.ndarray]:
    """For each level, which cells hold more than ``GROUP`` suffixes."""
    levels = [n for n in LEVELS if n < window]
    slices = 64

    def run(batches):
        counts = np.zeros((len(levels), cells), np.int64)
        for rows in batches:
            hashes, _, at = _suffixes(rows, window)
            for i, n in enumerate(levels):
                counts[i] += np.bincount((_prefix(hashes, at, n) % np.uint64(cells)).astype(np.int64), minlength=cells)
        if counts.any():
            parts = counts.reshape(len(levels) * slices, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(parts), dtype=np.int32)),
                 pa.array([packed(p) for p in parts], pa.binary())], names=["slice", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = sum(unpacked(b) for b in table.column("counts").to_pylist())
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()),
                         "large": pa.array([np.packbits(total > GROUP).tobytes()], pa.binary())})

    found = (docs.mapInArrow(run, "slice int, counts binary").groupBy("slice")
             .applyInArrow(add, "slice int, large binary").collect())  # one bit a cell and level
    large = np.zeros((len(levels) * slices, cells // slices), bool)
    for row in found:
        large[row.slice] = np.unpackbits(np.frombuffer(row.large, np.uint8), count=cells // slices).astype(bool)
    return list(large.reshape(len(levels), cells))


def _spans(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words covered by windows at ``starts`` (sorted)."""
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > starts[:-1] + window
    last = np.append(new[1:], True)
    return starts[new], starts[last] + window


def _by_document(ids: np.ndarray, starts: np.ndarray, parts: int):
    """(part, blob) of flagged windows, dealt by document; ids ascending."""
    part = ids % parts
    for p in np.unique(part):
        at = part == p
        yield int(p), len(packed(ids[at])).to_bytes(4, "little") + packed(ids[at]) + packed(starts[at])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``starts`` and ``ends`` (word numbers) of the maximal runs of words
    covered by windows that occur earlier, for each document that has any."""
    spark = docs.sparkSession
    parts = ready(spark)
    groups = 4 * parts  # of suffixes; one at a time is in a worker's memory
    docs = documents(docs)
    cells = max(CELLS, 1 << int(np.ceil(np.log2(16 * parts))))
    levels = [n for n in LEVELS if n < window]
    shared = spark.sparkContext.broadcast(census(docs, window, cells))

    def split(batches):
        large = shared.value
        for rows in batches:
            rows = rows.take(pa.array(np.argsort(long_column(rows.column(0)), kind="stable")))
            ids = long_column(rows.column(0))
            hashes, firsts, at = _suffixes(rows, window)
            if not len(at):
                continue
            digest = runs(hashes, window)[at]
            # The first leaf of each window stays; the others repeat it.  Rows that share an
            # id count as one document.
            order = np.argsort(digest, kind="stable")
            again = np.zeros(len(at), bool)
            again[order[1:]] = digest[order[1:]] == digest[order[:-1]]
            row = np.searchsorted(firsts, at, "right") - 1
            start = at - firsts[row]
            out = []
            if again.any():
                twin = np.flatnonzero(again)
                heads = order[np.flatnonzero(~again[order])]
                head = heads[np.searchsorted(digest[heads], digest[twin])]
                late = twin[(ids[row[twin]] != ids[row[head]]) | (start[twin] != start[head])]
                if len(late):
                    out += [(groups + p, blob) for p, blob in _by_document(ids[row[late]], start[late], parts)]
            keep = np.flatnonzero(~again)
            key = digest[keep].copy()
            todo = np.arange(len(keep))
            for n, flags in zip(levels, large):
                prefix = _prefix(hashes, at[keep[todo]], n)
                long = flags[(prefix % np.uint64(cells)).astype(np.int64)]
                key[todo[~long]] = prefix[~long]
                todo = todo[long]
                if not len(todo):
                    break
            part = (mix(key) % np.uint64(groups)).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            found, begin = np.unique(part[by_part], return_index=True)
            about = packed(ids), packed(firsts)
            for p, a, b in zip(found, begin, [*begin[1:], len(by_part)]):
                some = keep[by_part[a:b]]
                pieces = [np.ascontiguousarray(digest[some].view(np.uint8).reshape(-1, 8)[:, :7]).tobytes(),
                          packed(at[some]), *about]
                out.append((int(p), b"".join([len(x).to_bytes(8, "little") for x in pieces] + pieces)))
            for i in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in out[i:i + 512]], pa.int32()),
                     pa.array([x for _, x in out[i:i + 512]], pa.binary())], names=["pid", "blob"])

    def subtrees(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pid, blobs = key[0].as_py(), table.column("blob").to_pylist()
        if pid >= groups:
            return pa.table({"part": pa.array([pid - groups] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})
        trim()
        digests, ids, starts = [], [], []
        for blob in blobs:
            sizes = np.frombuffer(blob, "<u8", 4).astype(np.int64)
            a = 32 + np.cumsum(sizes) - sizes
            n = sizes[0] // 7
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :7] = np.frombuffer(blob, np.uint8, 7 * n, 32).reshape(-1, 7)
            at, doc, firsts = (unpacked(blob[a[i]:a[i] + sizes[i]]) for i in (1, 2, 3))
            row = np.searchsorted(firsts, at, "right") - 1
            digests.append(wide.view(np.uint64).ravel())
            ids.append(doc[row])
            starts.append((at - firsts[row]).astype(np.int64))
        digest, ids, starts = np.concatenate(digests), np.concatenate(ids), np.concatenate(starts)
        order = np.argsort(digest, kind="stable")
        same = digest[order[1:]] == digest[order[:-1]]
        node = np.zeros(len(order), bool)
        node[1:] |= same
        node[:-1] |= same
        leaves = order[node]
        leaves = leaves[np.lexsort((starts[leaves], ids[leaves], digest[leaves]))]
        first = np.ones(len(leaves), bool)
        first[1:] = digest[leaves[1:]] != digest[leaves[:-1]]
        head = leaves[np.maximum.accumulate(np.where(first, np.arange(len(leaves)), 0))] if len(leaves) else leaves
        late = leaves[(ids[leaves] != ids[head]) | (starts[leaves] != starts[head])]
        late = late[np.lexsort((starts[late], ids[late]))]
        out = list(_by_document(ids[late], starts[late], parts)) if len(late) else []
        return pa.table({"part": pa.array([p for p, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, starts = [], []
        for blob in table.column("blob").to_pylist():
            n = 4 + int.from_bytes(blob[:4], "little")
            ids.append(unpacked(blob[4:n]))
            starts.append(unpacked(blob[n:]))
        ids, starts = np.concatenate(ids), np.concatenate(starts)
        order = np.lexsort((starts, ids))
        ids, starts = ids[order], starts[order]
        docs, begin = np.unique(ids, return_index=True)
        spans = [_spans(starts[a:b], window) for a, b in zip(begin, [*begin[1:], len(ids)])]
        return pa.table({"doc_id": pa.array(docs), "starts": pa.array([s for s, _ in spans], pa.list_(pa.int64())),
                         "ends": pa.array([e for _, e in spans], pa.list_(pa.int64()))})

    return (docs.mapInArrow(split, "pid int, blob binary")
            .groupBy("pid").applyInArrow(subtrees, "part int, blob binary")
            .groupBy("part").applyInArrow(merge, "doc_id long, starts array<long>, ends array<long>"))


def without_spans(text: str, starts, ends) -> tuple[int, int, str]:
    """The numbers of words and of removed words of a text, and its kept words."""
    words = text.encode("utf-8").split()  # at the six ASCII separators
    n = len(words)
    for a, b in zip(reversed(starts or ()), reversed(ends or ())):
        del words[a:b]
    return n, n - len(words), b" ".join(words).decode("utf-8")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one
    space) of every document."""
    # The spans are written first: their groups and the join never share an executor's memory.
    spans = staged(repeats(docs, window), "substrings")

    def cut(batches):
        for rows in batches:
            for i in range(0, rows.num_rows, 512):
                some = rows.slice(i, 512)
                total, removed, kept = zip(*map(without_spans, *(some.column(c).to_pylist() for c in (1, 2, 3))))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    # The same plan for any number of spans.
    return (documents(docs).join(spans.hint("merge"), "doc_id", "left").select("doc_id", "text", "starts", "ends")
            .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string"))


def kept_digests(kept: DataFrame) -> DataFrame:
    """The result of :func:`deduplicated` with a digest of the kept words."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
