"""The attempt log as published runs (SNK2/SNK3), its compacted state (SRC6, REL11) and
the totals that its writes count (AGG3, AGG4, FN18)."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from purchaseflow.operators.runlog import LEAST_PER_BUCKET, RunLog
from purchaseflow.operators.state import latest_attempts, pending_files
from purchaseflow.plans import fixtures as fx
from purchaseflow.schemas import ATTEMPTS


@pytest.fixture
def runs(spark, sf_small):
    att = fx.f6_attempts(spark, sf_small)
    return [att.filter(F.col("attempt_seq") % 3 == i).withColumn("attempt_seq", F.floor(F.col("attempt_seq") / 3).cast("long"))
            for i in range(3)]


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_a_run_is_in_the_log_once(spark, tmp_path, runs):
    log = RunLog(spark, str(tmp_path / "log"))
    assert log.attempts().count() == 0 and log.state().count() == 0 and log.compact() is None
    assert log.publish(runs[0], "a", 1)
    evaluated = runs[0].withColumn("file_name", F.raise_error(F.lit("evaluated again")).cast("string"))
    assert not log.publish(evaluated, "a", 1)
    # Two writers of the same run: both have their files, one is published.
    first, second = log.stage(runs[1], "b", 2), log.stage(runs[1], "b", 2)
    assert log.publish_staged(first) and not log.publish_staged(second)
    log.stage(runs[2], "c", 3)  # dies before it is published
    assert log.attempts().count() == runs[0].count() + runs[1].count()
    assert log.drop_unpublished() == 1
    assert log.publish(runs[2], "c", 3)
    assert log.attempts().count() == sum(r.count() for r in runs)


def test_run_ids_of_any_form(spark, tmp_path, runs):
    log = RunLog(spark, str(tmp_path / "log"))
    for i, name in enumerate(["2024-01-01T00:00:00", "a/b", "..", "é"]):
        assert log.publish(runs[0].limit(2), name, i) and not log.publish(runs[0], name, i)
    assert [r.run_id for r in log.runs()] == ["2024-01-01T00:00:00", "a/b", "..", "é"]
    assert log.attempts().count() == 8


def above(plan, mark):
    """The operators above the scan that has a mark."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and mark in line)
    depth, found = lines[at].index("-"), []
    for line in reversed(lines[:at]):
        if "-" in line[:depth] and line.index("-") < depth:
            depth = line.index("-")
            found.append(line)
    return " ".join(found)


@pytest.mark.parametrize("files_per_bucket", [7, 1 << 20])
def test_state_after_a_snapshot_is_that_of_the_whole_log(spark, tmp_path, runs, files_per_bucket):
    log = RunLog(spark, str(tmp_path / "log"))
    for i, r in enumerate(runs):
        log.publish(r.filter(F.crc32("file_name") % 3 != i), f"run{i}", i)
        assert rows(log.state()) == rows(latest_attempts(log.attempts()))
        before = log.snapshot()
        after = log.compact(files_per_bucket)
        assert after.run_seq == i and after.n_files == log.state().count() and after != before
        assert log.compact() == after
        assert rows(log.state()) == rows(latest_attempts(log.attempts()))
        assert rows(log.state(["status"])) == rows(latest_attempts(log.attempts(), payload=["status"]))
    assert log.drop_unpublished() == 2  # the replaced snapshots


def test_the_snapshot_is_joined_in_its_buckets(spark, tmp_path, runs, monkeypatch):
    log = RunLog(spark, str(tmp_path / "log"))
    log.publish(runs[0], "a", 0)
    log.publish(runs[1], "b", 1)
    log.compact(20)
    log.publish(runs[2], "c", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = log.state(["status"])
        plan = state._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 3 and "Bucketed: true" in plan  # the snapshot, and the new run for places and columns
    assert "Exchange" not in above(plan, "Bucketed: true")
    assert all("raw_ocr" not in line.split("ReadSchema")[-1] for line in scans)
    folders = {f.split("/log/")[1].rsplit("/", 1)[0] for f in state.inputFiles()}
    assert folders == {log.runs()[-1].folder, log.snapshot().folder}


def test_totals_come_from_the_write(spark, tmp_path, runs):
    log = RunLog(spark, str(tmp_path / "log"))
    for i, r in enumerate(runs):
        log.publish(r, f"run{i}", i)
    log.publish(runs[0].limit(0), "none", 9)
    got = {r.run_id: r for r in log.run_metrics().collect()}
    assert (got["none"].n_attempts, got["none"].wall_time) == (0, 0.0)
    for i, r in enumerate(runs):
        want = r.agg(F.count("*").alias("n"), F.sum("processing_time").alias("p"), F.sum("wall_time").alias("w"),
                     F.count_if(F.col("status").isin("ok", "bad_json")).alias("ok")).first()
        assert (got[f"run{i}"].n_attempts, got[f"run{i}"].n_results, got[f"run{i}"].n_skipped) == (want.n, want.ok, want.n - want.ok)
        assert got[f"run{i}"].processing_time == pytest.approx(want.p) and got[f"run{i}"].wall_time == pytest.approx(want.w)


def test_a_snapshot_is_spread_over_the_shuffle_partitions(spark, tmp_path):
    """What reads a state has one task for each bucket: a snapshot of some files has several."""
    log = RunLog(spark, str(tmp_path / "log"))
    rows = spark.range(3 * LEAST_PER_BUCKET).select(*[
        (F.concat(F.lit("f"), "id") if f.name == "file_name" else F.col("id") if f.name == "attempt_seq"
         else F.lit("ok") if f.name == "status" else F.lit(None)).cast(f.dataType).alias(f.name) for f in ATTEMPTS.fields])
    log.publish(rows, "run1", 1)
    assert log.compact().buckets == 3
    state = log.state(["status"])
    assert state.rdd.getNumPartitions() == 3 and state.count() == 3 * LEAST_PER_BUCKET


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_writes_of_the_log_leave_no_shuffle_files(spark, tmp_path, runs):
    """q35 (F1): what a run or a snapshot has shuffled is not kept until the driver collects its garbage."""
    log, before = RunLog(spark, str(tmp_path / "log")), shuffle_files(spark)
    log.publish(runs[0].repartition(3, "file_name"), "a", 0)
    log.compact(20)
    until = time.time() + 20  # the files go in the background
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


def test_the_columns_of_the_latest_attempts_move_once(spark, runs):
    """q35 (F1): repeats are dropped where the rows meet their places, without another exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = latest_attempts(runs[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("SortMergeJoin")[0]


def test_a_log_without_runs_has_no_join(spark, tmp_path, runs):
    """q35 (F1): the texts of a first run are not shuffled to be compared with nothing."""
    todo = pending_files(runs[0].select("file_name", "raw_ocr"), RunLog(spark, str(tmp_path / "log")).state(["status"]))
    plan = todo._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_a_snapshot_in_slices_has_a_file_for_each_bucket(spark, tmp_path, runs):
    """q35 (F1): the state is written a slice of its buckets after another; none is left out or split."""
    log = RunLog(spark, str(tmp_path / "log"))
    log.publish(runs[0].unionByName(runs[0].limit(3)).unionByName(runs[0].limit(2).withColumn("file_name", F.lit(None).cast("string"))), "a", 0)
    snapshot = log.compact(20)
    names = [n for n in (tmp_path / "log" / snapshot.folder).iterdir() if n.name.startswith("part-")]
    buckets = [int(n.name.split("_")[1].split(".")[0]) for n in names]
    assert snapshot.buckets > 8 and len(buckets) == len(set(buckets)) and all(".zstd." in n.name for n in names)
    assert rows(log.state()) == rows(latest_attempts(log.attempts())) and snapshot.n_files == log.state().count()
