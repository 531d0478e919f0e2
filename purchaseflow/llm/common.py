"""Shared pieces of the training-data operators: input shaping, staged tables, text bytes.

Every operator takes the columns it needs by name and drops the rest first, so extra or
clashing columns of the caller never meet the operator's own.  Rows whose id is null have
no identity and take no part; a null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path, ship_package

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: it has no such call
    _LIBC = None

BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``text`` (never null) of every row that has an id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("doc_id IS NOT NULL")


def ready(spark: SparkSession) -> int:
    """Make the package importable on the executors, bound an Arrow batch,
    and return the number of shuffle partitions."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back: cuts lineage,
    and later passes see exactly the rows of the first.  ``session.release_scratch`` or
    :func:`discard` removes it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged_path = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and what the driver kept for them."""
    for df in tables:
        drop_scratch(df.sparkSession, df._staged_path)
    for df in tables[:1]:
        give_back(df.sparkSession)


def give_back(spark: SparkSession) -> None:
    """Let the driver collect its garbage, which is when Spark drops the shuffle files and
    broadcasts of finished work, and return what Python has freed to the system."""
    gc.collect()
    trim()
    spark._jvm.System.gc()


def held_out() -> Column:
    """The fifth of the documents whose labels no model may learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id`` and ``y`` of the labels outside the held-out fold.  A document with several
    labels counts as the largest."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
            .filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out())
            .groupBy("doc_id").agg(F.max("y").alias("y")))


def marked(hashes: DataFrame, column: str) -> np.ndarray:
    """A table of ``BITS`` bits, whatever the number of the hashes, two of which mark each."""
    place = F.explode(F.array(F.col(column).bitwiseAND(BITS - 1), F.shiftrightunsigned(column, 24).bitwiseAND(BITS - 1)))
    found = (hashes.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(31).cast("int"))).alias("bits"))
             .toArrow())  # at most BITS / 32 rows
    bits = np.zeros(BITS // 32, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits


def may_be_marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which unsigned hashes the table may know: all that it marks, and few others."""
    hit = np.ones(len(keys), bool)
    for p in (keys & np.uint64(BITS - 1), (keys >> np.uint64(24)) & np.uint64(BITS - 1)):
        p = p.astype(np.int64)
        hit &= (bits[p >> 5] >> (p & 31)) & 1 == 1
    return hit


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``doc_id``, ``text`` and ``y`` of at most ``per_class`` labelled documents of each
    class outside the held-out fold, in the order of a hash of the id."""
    known = known_labels(labels, label).join(documents(docs).select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    some = [known.filter(F.col("y") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    # At most 2 * per_class rows of an id and a class.
    return documents(docs).join(F.broadcast(some[0].unionAll(some[1])), "doc_id")


def fitted(sample: DataFrame, order: list[Column | str], fit: Callable[[list[pa.RecordBatch]], Any]) -> Any:
    """What ``fit`` makes of a sample of bounded size (None: no rows), in the given order.  It runs in one
    task, so the driver holds the model and never the sample."""
    def run(batches):
        rows = list(batches)
        trim()
        model = fit(rows)
        rows.clear()
        trim()
        yield batch(model=pa.array([pickle.dumps(model, protocol=5)], pa.binary()))

    found = sample.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    model = pickle.loads(found[0].model) if found else None  # Spark may skip an empty sample
    found.clear()
    give_back(sample.sparkSession)
    return model


def trim() -> None:
    """Give freed memory back to the system.  Python workers live on from stage to stage,
    and Arrow's pool and the C library keep what arrays of one batch or group have used."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    trim()
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(offsets) else raw, offsets - (offsets[0] if len(offsets) else 0)


def long_column(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def batch(**columns) -> pa.RecordBatch:
    """A record batch from numpy arrays or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


_ZSTD = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """Sorted or slowly growing integers as compressed differences."""
    deltas = np.diff(values.astype(np.int64), prepend=0)
    raw = deltas.tobytes()
    return len(values).to_bytes(4, "little") + bytes(_ZSTD.compress(raw))


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    return np.cumsum(np.frombuffer(_ZSTD.decompress(blob[4:], n * 8), np.int64))
