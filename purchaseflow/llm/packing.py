"""Concatenate and cut: documents as one token stream, cut into fixed windows.

First pass: every partition encodes its documents once and writes their ids with a
running offset inside the partition.  The partition totals (one row a partition) give the
partitions' starts in the stream by a prefix sum.  Second pass: each document knows its
global start and is cut at the window boundaries it meets; a document that crosses one
leaves a boundary record, that is a piece on either side.  No row moves between
partitions, and only the last window is not full.

Defined results: a null or empty text is a document of its end mark alone; rows with a
null id take no part; repeated rows are each packed; an empty table gives no pieces.  A text
of any length is encoded whole and becomes as many pieces as it meets windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import documents, long_column, ready, staged
from .token_ids import word_ids

LENGTH = 4096
END_ID = 2

_STORED = "part int, start long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of the document before it),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in that sequence.  ``path``: vocabulary file."""
    ready(docs.sparkSession)

    def encode(batches):
        encoder = word_ids(path)
        part, at = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for rows in batches:
            for begin in range(0, rows.num_rows, 512):
                some = rows.slice(begin, 512)
                ids, bounds = encoder.encode(some.column(1))
                sizes = np.diff(bounds) + 1
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                raw, bounds = ids.tobytes(), (2 * bounds).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), part, np.int32)), pa.array(starts), some.column(0), pa.array(sizes),
                     pa.array([raw[a:b] + end for a, b in zip(bounds, bounds[1:])], pa.binary())],
                    names=["part", "start", "doc_id", "doc_tokens", "ids"])

    stored = staged(documents(docs).mapInArrow(encode, _STORED), "packing")
    # One row a partition: the prefix sum over them is as small as the list of partitions.
    totals = stored.groupBy("part").agg(F.max(F.col("start") + F.col("doc_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches):
        for rows in batches:
            begins, sizes = long_column(rows.column(0)), long_column(rows.column(2))
            first, last = begins // length, (begins + sizes - 1) // length
            pieces = (last - first + 1).astype(np.int64)
            row = np.repeat(np.arange(rows.num_rows), pieces)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            a = np.maximum(sequence * length, begins[row])
            b = np.minimum((sequence + 1) * length, (begins + sizes)[row])
            ids = rows.column(3).to_pylist()
            start = a - begins[row]
            for i in range(0, len(row), 1024):
                s = slice(i, i + 1024)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(1).take(pa.array(row[s])), pa.array(start[s]), pa.array((b - a)[s]),
                     pa.array([np.frombuffer(ids[r], "<u2", n, 2 * f).astype("<u4").tobytes()
                               for r, f, n in zip(row[s], start[s], (b - a)[s])], pa.binary()),
                     pa.array(sizes[row[s]]), pa.array(sequence[s]), pa.array((a - sequence * length)[s])],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return (stored.join(F.broadcast(bases), "part")
            .select((F.col("base") + F.col("start")).alias("begin"), "doc_id", "doc_tokens", "ids")
            .mapInArrow(cut, _PIECES))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
