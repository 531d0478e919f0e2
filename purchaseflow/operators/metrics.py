"""Run metrics: running progress (AGG2), run totals (AGG3), mean time (AGG4) and
state counts (AGG5).

Running counts use a two-level prefix sum so no single task sorts a whole run:
rows are cut into buckets of ``bucket_width`` consecutive sequence numbers, bucket
totals are aggregated (partial aggregation, small output), an exclusive prefix over
the bucket totals gives each bucket's offset, and a window partitioned by
(run, bucket) adds the running count inside the bucket.  A run holding a third of
all rows is therefore spread over many buckets; only the small bucket-total table
is windowed per run.  The windowed rows are checkpointed, so the input is read and
shuffled once: the bucket totals are the last running counts of each bucket, and both
uses keep the partitioning of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .state import RESULT_STATUSES, SKIP_STATUSES

DEFAULT_BUCKET_WIDTH = 1 << 18


def running_counts(df: DataFrame, partition: list[str], order: str, flags: dict[str, Column],
                   bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Inclusive running ``count(*)`` (as ``n``) and running sums of 0/1 ``flags``
    over rows of each ``partition`` ordered by the unique, integral ``order`` column."""
    names = list(flags)
    b = df.select("*", *[F.when(c, 1).otherwise(0).alias(f"_f_{k}") for k, c in flags.items()],
                  F.floor(F.col(order) / F.lit(bucket_width)).alias("_bucket"))
    upto = Window.partitionBy(*partition, "_bucket").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = checkpointed(b.select(*df.columns, "_bucket", F.count(F.lit(1)).over(upto).alias("_w_n"),
                                   *[F.sum(f"_f_{k}").over(upto).alias(f"_w_{k}") for k in names]))
    totals = within.groupBy(*partition, "_bucket").agg(
        F.max("_w_n").alias("_t_n"), *[F.max(f"_w_{k}").alias(f"_t_{k}") for k in names])
    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *partition, "_bucket",
        F.coalesce(F.sum("_t_n").over(before), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names])
    joined = within.join(offsets, [*partition, "_bucket"])
    return joined.select(
        *df.columns, (F.col("_o_n") + F.col("_w_n")).alias("n"),
        *[(F.col(f"_o_{k}") + F.col(f"_w_{k}")).alias(k) for k in names])


def progress(attempts: DataFrame, bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """AGG2: after each attempt of a run, files processed so far, results so far and
    the success rate in percent (0 when nothing was processed).  As in the reference,
    timed-out and errored files count but print no progress line, so their rows are
    dropped after counting."""
    s = F.col("status")
    counted = running_counts(attempts.select("run_id", "attempt_seq", "file_name", "status"), ["run_id"], "attempt_seq",
                             {"succeeded": s.isin(*RESULT_STATUSES)}, bucket_width)
    rate = F.coalesce(F.try_divide(F.col("succeeded") * F.lit(100.0), F.col("n")), F.lit(0.0))
    return (counted.filter(~F.col("status").isin("timeout", "error"))
            .select("run_id", "attempt_seq", "file_name", F.col("n").alias("processed"),
                    "succeeded", F.round(rate, 6).alias("success_rate")))


def run_totals(attempts: DataFrame) -> DataFrame:
    """AGG3: per run, attempts, results and skipped files."""
    s = F.col("status")
    return attempts.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if(s.isin(*RESULT_STATUSES)).alias("n_results"),
        F.count_if(s.isin(*SKIP_STATUSES)).alias("n_skipped"))


def mean_processing_time(attempts: DataFrame) -> DataFrame:
    """AGG4: mean processing time over the results of each run (runs without results
    are absent, as the reference prints nothing then)."""
    return (attempts.filter(F.col("status").isin(*RESULT_STATUSES))
            .groupBy("run_id").agg(F.round(F.avg("processing_time"), 6).alias("mean_time"),
                                   F.count(F.lit(1)).alias("n_results")))


def state_counts(states: DataFrame) -> DataFrame:
    """AGG5: number of files per state."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n_files"))
