"""Separated text whose quoted fields may hold line breaks, read by many tasks a file (SRC4).

A line break ends a record only where the quotes before it are even in number.  Spark's
text source cuts a file at line breaks into byte ranges, so the first pass counts the quotes
of every range; a prefix sum over a file's ranges tells whether each begins inside quotes.
With that, every task cuts its own range into records.  What is left at a range's edges (the
end of a record that began before, the beginning of one that goes on) are fragments, at most
two a range, which are put together by file and place.  No line is shuffled but those.

The ranges of all passes are the same as long as the files and Spark's file settings are; a
range that the first pass has not seen is an error.  Quotes must be balanced, as writers of
the format do it: a field that holds a quote is quoted, and the quote is doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

_PIECES = "file long, range long, at long, begins boolean, ends boolean, text string"
_RANGES = "file long, range long, quotes long, header string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Physical lines in their order, with the file and the byte range they come from."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("range"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.RecordBatch]]:
    """(file, range, first of it, lines) of runs of lines that lie in one range."""
    now = None
    for rows in batches:
        if not rows.num_rows:
            continue
        file, place = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (place[1:] != place[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, rows.num_rows]):
            key = int(file[a]), int(place[a])
            yield *key, key != now, rows.slice(a, b - a)
            now = key


def _quotes(lines: pa.RecordBatch, quote: str) -> np.ndarray:
    return pc.count_substring(lines.column(0), quote).to_numpy().astype(np.int64)


def _ranges(spark: SparkSession, path: str, quote: str) -> DataFrame:
    """Every range with the number of its quotes and, where a file begins, its first line."""
    def count(batches):
        out: dict[tuple[int, int], list] = {}
        for file, place, first, lines in _by_range(batches):
            if first:
                out[file, place] = [0, lines.column(0)[0].as_py() if place == 0 else None]
            out[file, place][0] += int(_quotes(lines, quote).sum())
        if out:
            yield pa.RecordBatch.from_pylist([{"file": f, "range": r, "quotes": q, "header": h} for (f, r), (q, h) in out.items()],
                                             schema=pa.schema([("file", pa.int64()), ("range", pa.int64()), ("quotes", pa.int64()), ("header", pa.string())]))

    found = scratch_path(spark, "ranges")
    _lines(spark, path).mapInArrow(count, _RANGES).write.parquet(found)
    return spark.read.schema(_RANGES).parquet(found)


def _pieces(spark: SparkSession, path: str, starts: DataFrame, quote: str, fragments: bool) -> DataFrame:
    """The whole records of all ranges, or the fragments at their edges."""
    def cut(batches):
        held: list[str] = []        # lines of the record that is open
        inside = begun = False      # quotes open before the next line; the record begins in this range
        key, at, number = None, 0, 0
        out: list[tuple] = []

        def close(ends: bool):
            if held and fragments != (begun and ends):
                out.append((*key, at, begun, ends, "\n".join(held)))

        for file, place, first, lines in _by_range(batches):
            if first:
                close(False)
                known = lines.column(3)[0].as_py()
                if known is None:
                    raise RuntimeError("the byte ranges of the files changed between two passes")
                held, inside, begun, key, at, number = [], known, not known, (file, place), 0, 0
            values = lines.column(0).to_pylist()
            odd = inside + np.cumsum(_quotes(lines, quote))
            ended = np.flatnonzero(odd % 2 == 0) + 1  # lines after which no quote is open
            done = 0
            for end in ended.tolist():
                if fragments and begun and not held:  # a whole record: the other pass has it
                    done = end
                    continue
                held += values[done:end]
                close(True)
                held, begun, at, done = [], True, number + end, end
            if fragments and begun and not held:
                at = number + done
            held += values[done:]
            inside, number = int(odd[-1]) % 2, number + lines.num_rows
            if len(out) >= 512:
                yield _batch(out)
                out = []
        close(False)
        if out:
            yield _batch(out)

    # One row of three numbers a byte range, as many as Spark's own list of them.
    lines = _lines(spark, path).join(F.broadcast(starts.select("file", "range", "inside")), ["file", "range"], "left")
    return lines.select("value", "file", "range", "inside").mapInArrow(cut, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
        pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names=["file", "range", "at", "begins", "ends", "text"])


def read_records(spark: SparkSession, path: str, quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """The records of all files at ``path`` (``file``, ``range`` and ``at``: where they
    begin, ``text``) without the empty ones, and each file's ``header``, its first line."""
    ship_package(spark)
    ranges = _ranges(spark, path, quote)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "range", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    whole = _pieces(spark, path, starts, quote, False).select("file", "range", "at", "text")
    left = scratch_path(spark, "fragments")
    _pieces(spark, path, starts, quote, True).write.parquet(left)
    fragments = spark.read.schema(_PIECES).parquet(left)
    # A fragment that doesn't begin a record goes on with the last one that does.
    order = Window.partitionBy("file").orderBy("range", "begins")
    owner = fragments.select("file", "range", "begins", F.last(F.when(F.col("begins"), F.struct("range", "at")), ignorenulls=True)
                             .over(order).alias("record"))
    joined = (fragments.select("file", "range", "begins", "text").join(owner, ["file", "range", "begins"])
              .groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("range", "begins", "text"))).alias("parts"))
              .select("file", "record.range", "record.at", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))
    records = whole.unionByName(joined).filter(F.rtrim("text", F.lit("\r")) != "")
    return records, ranges.filter("range = 0").select("file", F.rtrim("header", F.lit("\r")).alias("header"))


def read_fields(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """The fields ``names`` of all records as texts, found by each file's own header; a
    field that a file doesn't have is null."""
    records, headers = read_records(spark, path, options["quote"])
    # As many fields as the widest header has separators, and one more.
    sep = options["sep"]
    width = headers.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(sep), F.lit(""))))).first()[0]
    if width is None:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    cells = [f"c{i}" for i in range(width // len(sep) + 1)]
    parse = {k: options[k] for k in ("sep", "quote", "escape")} | {"multiLine": "true"}

    def fields(text: str) -> Column:
        row = F.from_csv(F.rtrim(text, F.lit("\r")), ", ".join(f"{c} string" for c in cells), parse)
        return F.array(*[row[c] for c in cells])

    places = headers.select("file", fields("header").alias("names")).select(
        "file", *[F.array_position("names", n).alias(f"p{i}") for i, n in enumerate(names)])
    rows = (records.filter(~((F.col("range") == 0) & (F.col("at") == 0))).select("file", fields("text").alias("cells"))
            .join(places, "file"))
    return rows.select([F.when(F.col(f"p{i}") > 0, F.get("cells", (F.col(f"p{i}") - 1).cast("int"))).alias(n) for i, n in enumerate(names)])
