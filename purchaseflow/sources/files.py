"""Image folder scan (SRC1), ordered slice (SRC2) and the file-type filter (SRC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.media import IMAGE_EXTENSIONS, extension
from ..functions.text import uri_base_name
from ..operators.selection import Sorted, literal, places_of

# Fixed value: case-sensitive suffix glob of the folder scan (non-recursive).
IMAGE_GLOB = "*.{jpg,jpeg,png}"

def scan_images(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """SRC1: the image files directly in ``folder`` (``*.jpg``, ``*.jpeg``, ``*.png``,
    case-sensitive, no sub-folders) -> ``file_name, path, length, modification_time``
    [+ ``content``].  ``content`` is only read when selected: the binary file source
    prunes it from the read schema otherwise."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB)
          .option("recursiveFileLookup", "false").load(folder))
    cols = [uri_base_name(F.col("path")).alias("file_name"), "path", "length",
            F.col("modificationTime").alias("modification_time")]
    if with_content:
        cols.append("content")
    return df.select(*cols)


def image_type_filter(df: DataFrame, name: str = "file_name") -> DataFrame:
    """SRC3: keep files whose suffix (any case) is jpg, jpeg or png."""
    return df.filter(extension(F.col(name)).isin(IMAGE_EXTENSIONS))


def slice_files(df: DataFrame, start: int | None, end: int | None,
                order: list[str] | None = None) -> DataFrame:
    """SRC2: rows ``[start, end)`` of ``df`` sorted by ``order`` (zero-based, half-open,
    applied only when both bounds are given, as in the reference).  The rows come in no
    particular order.

    Rows that tie in ``order`` are taken in the order of their other plain columns.  The keys
    at both ends are selected without sorting the table (:mod:`..operators.selection`), and
    the rows between them are a filter of ``df``, pushed to its scan by the first column: an
    image's content is read for the slice only, and neither sorted nor shuffled.  Of rows
    alike in all plain columns at an end, as many are taken as belong to the slice.
    """
    if start is None or end is None:
        return df
    if start < 0 or end < 0:
        raise ValueError("slice bounds must be non-negative")
    order = order or ["file_name"]
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]
    keys = df.select(*order, *[c for c in plain if c not in order])
    n = keys.count()
    end = min(end, n)
    if end <= start:
        return df.limit(0)
    low, high = places_of(keys, [start, end - 1], n)
    value, low_key, high_key = F.struct(*keys.columns), literal(keys, low.key, keys.columns), literal(keys, high.key, keys.columns)
    first, kind = F.col(order[0]), df.schema[order[0]].dataType
    at_least, at_most = (F.lit(k.key[order[0]]).cast(kind) for k in (low, high))
    pushed = ((F.lit(True) if low.key[order[0]] is None else first >= at_least)
              & (first.isNull() if high.key[order[0]] is None else first.isNull() | (first <= at_most)))
    near = df.filter(pushed)
    if low.before == start and high.before + high.equal == end:
        return near.filter((value >= low_key) & (value <= high_key))
    if low.before == high.before:
        return _some_of(near.filter(value.eqNullSafe(low_key)), start - low.before, end - low.before)
    return (near.filter((value > low_key) & (value < high_key))
            .unionAll(_some_of(near.filter(value.eqNullSafe(low_key)), start - low.before, low.equal))
            .unionAll(_some_of(near.filter(value.eqNullSafe(high_key)), 0, end - high.before)))


def _some_of(alike: DataFrame, a: int, b: int) -> DataFrame:
    """Rows [a, b) of rows that are alike, counted over their partitions."""
    stored = Sorted(alike, [], sort=False)
    before, ranges = 0, F.lit(False)
    for p in stored.parts:
        low, high = max(a - before, 0), min(b - before, p.n)
        if low < high:
            ranges |= F.col("_at").between(p.first + low, p.first + high - 1)
        before += p.n
    return stored.rows.filter(ranges).select(*alike.columns)
