"""Queries over published runs and planned starts: q41-q45."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runlog import RunLog
from ..operators.schedule import slot_schedule
from ..session import scratch_path
from ..schemas import RESULT_COLUMNS
from ..sinks.outputs import WRITE_OPTIONS
from ..sources.results import read_results
from . import fixtures as fx
from .io_queries import doc_results
from .state_queries import q31_retry_plan

GAP_SECONDS = 5.0


def runs_of(spark: SparkSession, sf_dir: str, n: int) -> list[DataFrame]:
    """F6 as ``n`` runs that all number their attempts from 0."""
    att = fx.f6_attempts(spark, sf_dir)
    k = F.col("attempt_seq")
    return [att.filter(k % n == i).withColumn("attempt_seq", F.floor(k / n).cast("long")) for i in range(n)]


def q41_compacted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL11 + SNK3 + SRC6: three runs, compacted after the second; the state is that of
    the snapshot and the last run."""
    log = RunLog(spark, scratch_path(spark, "q41-log"))
    first, second, third = runs_of(spark, sf_dir, 3)
    log.publish(first, "run1", 1)
    log.publish(second, "run2", 2)
    log.compact()
    log.publish(third, "run3", 3)
    return log.state(["status", "run_id"])


def q42_publish_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2/SNK3: a run that is published twice and one that died half-way and was
    submitted again; each attempt is in the log once."""
    log = RunLog(spark, scratch_path(spark, "q42-log"))
    first, second = runs_of(spark, sf_dir, 2)
    log.publish(first, "run1", 1)
    log.publish(first, "run1", 1)
    log.stage(second.filter(F.col("attempt_seq") % 2 == 0), "run2", 2)  # never published
    log.publish(second, "run2", 2)
    return log.attempts().select("run_id", "run_seq", "attempt_seq", "file_name", "status", "error", "processing_time")


def q43_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: result files of two column orders in one folder, with pipes, quotes and line
    breaks inside fields, cut into byte ranges wherever Spark cuts them."""
    path = scratch_path(spark, "q43-results")
    rows = doc_results(spark, sf_dir)
    number = F.regexp_extract("File_Name", r"\d+", 0).cast("long")
    for i, columns in enumerate((RESULT_COLUMNS, RESULT_COLUMNS[::-1])):
        rows.filter(number % 2 == i).select(columns).write.mode("append").options(**WRITE_OPTIONS).csv(path)
    return read_results(spark, path, na_as_missing=False).select(*RESULT_COLUMNS)


def q44_slot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENR5 + ENR4: retries after their waits and files without an attempt (from the log's
    first moment on), one start at a time."""
    att = fx.f6_attempts(spark, sf_dir)
    retries = q31_retry_plan(spark, sf_dir).filter("NOT give_up").select(
        "file_name", "attempt_seq", F.col("next_attempt_at").alias("released_at"))
    begin = F.lit(att.agg(F.min("attempted_at")).first()[0]).cast("timestamp_ntz")
    new = fx.customer_files(spark, sf_dir).join(att.select("file_name").distinct(), "file_name", "left_anti").select(
        "file_name", F.lit(None).cast("long").alias("attempt_seq"), begin.alias("released_at"))
    return slot_schedule(retries.unionByName(new), "released_at", ["file_name", "attempt_seq"], GAP_SECONDS)


def q45_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18 + AGG3: both times and the totals of each run, as the write of the run counted
    them; the result reads the manifests only."""
    log = RunLog(spark, scratch_path(spark, "q45-log"))
    for i, run in enumerate(runs_of(spark, sf_dir, 2), 1):
        log.publish(run, f"run{i}", i)
    return log.run_metrics().select("run_id", "n_attempts", "n_results", "n_skipped", F.round("processing_time", 3).alias("processing_time"),
                                    F.round("wall_time", 3).alias("wall_time"))
