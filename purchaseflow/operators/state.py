"""Resumable per-file state over the append-only attempt log.

REL11 (latest wins upsert), REL13 (union of old and new rows), REL1 (completed /
placeholder split), REL2 (pending files), REL3 (dummy-row filter) and REL12's
placeholder rows.

Scale notes: the latest place of a file is found by one hash aggregation over a number
(partial in every map task, so a file with a huge number of attempts is pre-reduced), and
its columns are then fetched by (file, place).  Pending files are a left-anti join;
Catalyst/AQE broadcast the smaller side only when its measured size is under the broadcast
threshold and fall back to a shuffled join otherwise.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import RESULT_COLUMNS

RESULT_STATUSES = ("ok", "bad_json")            # a result dict was produced
SKIP_STATUSES = ("failed", "timeout", "error")  # placeholder row + skipped entry


LOG_ORDER = ["run_seq", "attempt_seq"]
SEQ_RANGE = Decimal(1 << 63)  # more than any number within a run


def latest_attempts(attempts: DataFrame, key: str = "file_name", order: list[str] | None = None,
                    payload: list[str] | None = None) -> DataFrame:
    """REL11: one row per file, the attempt with the highest place in the log, plus
    ``first_seen`` (the lowest sequence number of its first run, for output order) and
    ``n_attempts``.

    ``order`` is the log's order: the run, then the number within the run
    (``LOG_ORDER``), or a single column that is unique over all runs.  ``payload`` limits
    the columns that are fetched (default: all); say so when only the status is needed:
    the large texts are then neither read nor shuffled.  Rows repeated exactly count as
    one result.
    """
    order = order or LOG_ORDER
    columns = [c for c in (payload or attempts.columns) if c not in (key, *order)]
    if len(order) == 1:
        seq = order[0]
        places = attempts.groupBy(key).agg(F.max(seq).alias(seq), F.min(seq).alias("first_seen"), F.count(F.lit(1)).alias("n_attempts"))
        return (attempts.select(key, seq, *columns).join(places, [key, seq]).distinct()
                .select(key, *columns, seq, "first_seen", "n_attempts"))
    # A place over all runs is one number, so its extremes are found by hash in one pass.
    run, seq = order
    place = F.col(run).cast("decimal(17,0)") * F.lit(SEQ_RANGE) + F.col(seq)
    marked = attempts.select(key, *order, *columns, place.alias("_place"))
    places = attempts.select(key, place.alias("_place")).groupBy(key).agg(
        F.max("_place").alias("_place"), F.min("_place").alias("_first"), F.count(F.lit(1)).alias("n_attempts"))
    # Repeats go while the rows are still dealt by file and place: the columns move once.
    return marked.join(places, [key, "_place"]).distinct().select(
        key, *columns, *order, (F.col("_first") % F.lit(SEQ_RANGE)).cast("long").alias("first_seen"), "n_attempts")


def union_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """REL13: prior rows and new rows in one frame (missing columns become null)."""
    return existing.unionByName(new, allowMissingColumns=True)


def state_of(latest: DataFrame) -> DataFrame:
    """REL1 on the attempt log: ``completed`` when the latest attempt produced a named
    receipt (status ``ok``); ``placeholder`` otherwise -- a bad-JSON record has a blank
    business name and is retried like a failure (quirk K3)."""
    return latest.withColumn(
        "state", F.when(F.col("status") == "ok", F.lit("completed")).otherwise(F.lit("placeholder")))


def split_results(results: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """REL1 on a result table (CSV interop): blank or null ``Business_Name`` is a
    placeholder when the file is in the current slice, ``outside`` when not;
    any other row is completed.  Adds ``state``."""
    blank = F.col("Business_Name").isNull() | (F.col("Business_Name") == "")
    if files is None:
        in_slice = F.lit(True)
        df = results
    else:
        marks = files.select(F.col("file_name").alias("File_Name")).distinct() \
            .withColumn("_in_slice", F.lit(True))
        df = results.join(marks, "File_Name", "left")
        in_slice = F.coalesce(F.col("_in_slice"), F.lit(False))
    out = df.withColumn("state", F.when(~blank, F.lit("completed"))
                        .when(in_slice, F.lit("placeholder")).otherwise(F.lit("outside")))
    return out.drop("_in_slice") if files is not None else out


def pending_files(files: DataFrame, latest: DataFrame) -> DataFrame:
    """REL2: files of the folder (or slice) without a completed latest attempt."""
    done = latest.filter(F.col("status") == "ok").select("file_name")
    return files.join(done, "file_name", "left_anti")


def pending_from_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """REL2 for CSV interop: files of the slice without a result row, or with a row that
    is a placeholder (blank or null ``Business_Name``)."""
    named = F.coalesce(F.col("Business_Name"), F.lit("")) != ""
    done = results.groupBy("File_Name").agg(F.bool_and(named).alias("done")).filter("done")
    return files.join(done.select(F.col("File_Name").alias("file_name")), "file_name", "left_anti")


def drop_dummy_rows(results: DataFrame) -> DataFrame:
    """REL3: keep rows with a non-blank ``File_Name`` (null counts as blank)."""
    return results.filter(F.coalesce(F.col("File_Name"), F.lit("")) != "")


def placeholder_rows(files: DataFrame) -> DataFrame:
    """REL12: the result-schema row written for a failed, timed-out or errored file."""
    zero = F.lit(0.0)
    blank = F.lit("")
    return files.select(
        F.col("file_name").alias("File_Name"), blank.alias("Business_Name"),
        blank.alias("Business_Address"), blank.alias("Date"), blank.alias("Items"),
        zero.alias("Subtotal"), zero.alias("Tax"), zero.alias("Total"),
        zero.alias("Processing_Time_Seconds"), blank.alias("Raw_OCR"),
        F.lit("{}").alias("Extracted_JSON")).select(*RESULT_COLUMNS)


def skipped_paths(latest: DataFrame) -> DataFrame:
    """SNK4 rows: distinct paths of files whose latest attempt was skipped.  (The
    reference keeps every skip, repeats included, even after a later success --
    quirk K10; this is the latest-state form.)"""
    return latest.filter(F.col("status").isin(*SKIP_STATUSES)).select("path").distinct()
