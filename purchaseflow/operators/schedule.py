"""One rate for a whole run (ENR5 with ENR4): a slot for every pending file and retry.

The reference pauses between records; tasks that pause each by themselves would together go
at as many times the rate.  Here the starts are planned first: in the order of their
release, each record gets the earliest start that keeps the gap to the one before and is
not before its own release (now, or the end of a retry's wait).  With records numbered k in
that order, the start is ``k * gap + max(release_j - j * gap for j <= k)``, so both the
number and the maximum are prefix scans: within the partitions of a range sort, and over
one row a partition.  No task sees more than its partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .extract import GAP_S

_MICROS = 1_000_000


def slot_schedule(tasks: DataFrame, release: str, order: list[str], gap_s: float = GAP_S[1]) -> DataFrame:
    """``tasks`` with their ``slot`` (from 0) and ``start_at``.  ``release``: the timestamp
    before which a task must not start; a null one may start with the first that has one (at
    the epoch if none has).  ``order`` settles ties, so it should tell tasks apart."""
    spark, gap = tasks.sparkSession, round(gap_s * _MICROS)
    path = scratch_path(spark, "schedule")
    key = [release, *order]
    (tasks.repartitionByRange(*key).sortWithinPartitions(*key)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    sorted_ = spark.read.parquet(path)
    at, part = F.col("_at").bitwiseAND((1 << 33) - 1), F.shiftright("_at", 33)
    first = F.lit(sorted_.agg(F.min(release)).first()[0]).cast("timestamp")
    due = F.unix_micros(F.coalesce(F.col(release).cast("timestamp"), first, F.timestamp_micros(F.lit(0))))
    rows = sorted_.select("*", part.alias("_part"), at.alias("_k"), (due - at * gap).alias("_lead"))
    # One row a partition.
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max("_lead").alias("lead"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("_part", "lead", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    based = based.select("_part", "_base", F.max(F.col("lead") - F.col("_base") * gap).over(before).alias("_carry"))
    upto = Window.partitionBy("_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_most", F.max("_lead").over(upto)).join(based, "_part")
    slot = F.col("_base") + F.col("_k")
    start = slot * gap + F.greatest("_carry", F.col("_most") - F.col("_base") * gap)
    return found.select(*tasks.columns, slot.alias("slot"), F.timestamp_micros(start).cast("timestamp_ntz").alias("start_at"))
