"""Queries over labelled responses (q12, q13) and the attempt log (q14-q22, q31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import retry_plan
from ..operators.labelled import labelled_items, labelled_receipts, parse_labelled
from ..operators.metrics import (mean_processing_time, progress, run_totals, running_counts,
                                 state_counts)
from ..operators.state import (SKIP_STATUSES, drop_dummy_rows, latest_attempts, pending_files,
                               placeholder_rows, skipped_paths, state_of, union_rows)
from . import fixtures as fx

def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.f5_labelled(spark, sf_dir).select(
        "o_orderkey", "file_name", parse_labelled(F.col("body")).alias("prediction"))


def q12_label_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL9 header values (last wins) + AGG1 price subtotal of the pivoted items,
    inside each document's row."""
    r = labelled_receipts(labelled_docs(spark, sf_dir), ["o_orderkey", "file_name"])
    return r.withColumn("subtotal", F.round("subtotal", 2))


def q13_cell_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL10 + REL7 + FN2 + FN6: one row per complete table item."""
    items = labelled_items(labelled_docs(spark, sf_dir), ["o_orderkey", "file_name"])
    return items.select("o_orderkey", "file_name", "row", "description", "price", "quantity")


# Columns the state queries need from the latest attempt (the texts stay behind).
STATE_PAYLOAD = ["status", "path", "run_id"]


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_attempts(fx.f6_attempts(spark, sf_dir), order=["attempt_seq"], payload=STATE_PAYLOAD)


def q14_state_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL1: completed / placeholder per file from its latest attempt."""
    return state_of(latest(spark, sf_dir)).select("file_name", "attempt_seq", "status", "state")


def q15_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL2: files of the folder (one per customer) without a completed latest attempt."""
    return pending_files(fx.customer_files(spark, sf_dir), latest(spark, sf_dir))


def q16_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL13 + REL11: earlier and newer attempt batches unioned, latest wins per file."""
    att = fx.f6_attempts(spark, sf_dir)
    earlier = att.filter(F.col("attempt_seq") % 2 == 0)
    newer = att.filter(F.col("attempt_seq") % 2 == 1)
    return latest_attempts(union_rows(earlier, newer), order=["attempt_seq"],
                           payload=["status", "processing_time", "run_id"]).select(
        "file_name", "attempt_seq", "status", "processing_time", "run_id", "first_seen", "n_attempts")


def q17_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL12 + REL3: placeholder result rows of files whose latest attempt was skipped."""
    skipped = latest(spark, sf_dir).filter(F.col("status").isin(*SKIP_STATUSES))
    return drop_dummy_rows(placeholder_rows(skipped))


def q18_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4 rows: distinct paths whose latest attempt was skipped."""
    return skipped_paths(latest(spark, sf_dir))


def q19_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG2: running processed / succeeded / success rate per run."""
    return progress(fx.f6_attempts(spark, sf_dir))


def q20_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG3: attempts, results and skipped files per run."""
    return run_totals(fx.f6_attempts(spark, sf_dir))


def q21_mean_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG4: mean processing time of the results of each run."""
    return mean_processing_time(fx.f6_attempts(spark, sf_dir))


def q22_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: files per state."""
    return state_counts(state_of(latest(spark, sf_dir)))


def q31_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENR3-ENR5 as a plan: for every skipped attempt, its retry number within the
    file's run, the wait before the next attempt by its error (429: ``2^n * 30 + jitter``,
    400 of the first step: 5 s), when that is, and whether it is given up."""
    att = fx.f6_attempts(spark, sf_dir).select("file_name", "run_id", "attempt_seq", "status", "error", "attempted_at")
    skip = F.col("status").isin(*SKIP_STATUSES)
    counted = running_counts(att, ["file_name", "run_id"], "attempt_seq", {"skips": skip}).filter(skip)
    retry_no = F.col("skips") - 1
    jitter = F.lit(1) + F.col("attempt_seq") % 30
    plan = retry_plan(F.col("error"), retry_no, F.col("attempted_at"), jitter)
    return counted.select("file_name", "attempt_seq", "error", retry_no.alias("retry_no"),
                          plan["wait_seconds"].alias("wait_seconds"),
                          plan["next_attempt_at"].alias("next_attempt_at"),
                          plan["give_up"].alias("give_up"))


def q33_run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL11 over two runs whose sequence numbers overlap: the later run wins."""
    return latest_attempts(fx.two_runs(spark, sf_dir), payload=["status", "run_id"])


def q38_dummy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL3: rows with a blank or null file name go."""
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.lit("")).when(k % 6 > 1, F.concat(F.lit("r"), k.cast("string"), F.lit(".jpg")))
    return drop_dummy_rows(c.select("c_custkey", name.alias("File_Name")))
