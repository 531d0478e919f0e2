"""The batch job as one callable: scan or slice, pending, extract, publish, derive, write.

The attempt log is the only state (:mod:`purchaseflow.operators.runlog`).  A run publishes
its attempts first, in one write that evaluates the extractor once and stores whether an
answer is a receipt, and derives everything else from the log.  A run that dies before it is
published has changed nothing; one that is submitted again under its id adds nothing.  What
is done and what failed comes from the log's state, so a run reads the last snapshot and the
runs after it, not the whole log, and parses no earlier answer to find its pending files.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.outputs import write_results, write_skipped
from ..sources.files import slice_files
from .receipts import is_receipt, resolve_status, to_result_rows, validate_receipts
from .runlog import RunLog
from .state import latest_attempts, pending_files, skipped_paths

RESULT_PAYLOAD = ["status", "response", "raw_ocr", "processing_time"]


def with_answer_status(attempts: DataFrame) -> DataFrame:
    """An answer that is no receipt is not done (quirk K3)."""
    bad = (F.col("status") == "ok") & ~is_receipt(F.col("response"))
    return attempts.withColumn("status", F.when(bad, F.lit("bad_json")).otherwise(F.col("status")))


def done_files(log: DataFrame) -> DataFrame:
    """The latest attempt of each file of a log whose answers were not looked at when they
    were appended: its file is pending again where the answer is no receipt."""
    return with_answer_status(latest_attempts(log, payload=["status", "response", "path"])).drop("response")


def results_of(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The result rows of all attempts of a log: see :func:`results_of_state`."""
    return results_of_state(latest_attempts(log, payload=RESULT_PAYLOAD), keep)


def results_of_state(latest: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The result rows of the latest attempts: validated receipts, blank records for answers
    that are none, placeholders for files without an answer."""
    return to_result_rows(resolve_status(validate_receipts(latest)), keep=keep)


def run_batch(spark: SparkSession, files: DataFrame, stage: Callable[[DataFrame], DataFrame], log_path: str,
              results_path: str | None = None, skipped_path: str | None = None,
              start: int | None = None, end: int | None = None, order: list[str] | None = None,
              run_id: str | None = None, run_seq: int | None = None) -> DataFrame:
    """One run over ``files`` (``file_name``, ``path`` and whatever ``stage`` needs).

    ``stage`` turns pending files into attempt rows (:func:`extract.extract` with a client,
    or the offline extractor).  ``run_id`` names the run: a run that is submitted again under
    it is in the log once (default: its own start); ``run_seq`` is its place in the log.
    Returns the result rows of the whole log, which are also written to ``results_path``; the
    paths of files without an answer go to ``skipped_path``.  Both must be fresh locations.
    """
    log = RunLog(spark, log_path)
    chosen = slice_files(files, start, end, order)
    begun = time.time_ns() // 1_000_000 if run_seq is None else run_seq
    todo = pending_files(chosen, log.state(["status"]))
    log.publish(with_answer_status(stage(todo)), run_id or f"run-{time.time_ns()}", begun)
    rows = results_of_state(log.state(RESULT_PAYLOAD))
    if results_path:
        write_results(rows, results_path)
    if skipped_path:
        write_skipped(skipped_paths(log.state(["status", "path"])), skipped_path)
    return rows
