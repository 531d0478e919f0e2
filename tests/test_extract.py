"""T4 resume and T5 failure routing of the extraction stage and the batch job."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from purchaseflow.operators.extract import (BAD_REQUEST_WAIT_S, ExtractTimeout, answer_of_text, extract,
                                            extract_offline, retry_plan, retry_wait, run_one)
from purchaseflow.operators.job import done_files, results_of, run_batch
from purchaseflow.operators.receipts import resolve_status, to_result_rows, validate_receipts
from purchaseflow.operators.state import latest_attempts, pending_files, skipped_paths
from purchaseflow.sinks.outputs import append_attempts
from purchaseflow.sources.results import load_attempts, read_results


class Clock:
    def __init__(self):
        self.t = 0.0

    def __call__(self):
        return self.t

    def sleep(self, s):
        self.t += s


class Fake:
    """Behaviour by file name: ok, bad JSON, no answer, slow, 429 twice then ok, error."""

    def __init__(self):
        self.calls = {}

    def ocr(self, record, limit_s):
        self.name = name = record["file_name"]
        self.calls[name] = self.calls.get(name, 0) + 1
        if name.startswith("none"):
            return None
        if name.startswith("slow"):
            raise ExtractTimeout("too slow")
        if name.startswith("rate") and self.calls[name] <= 2:
            raise RuntimeError("HTTP 429 Too Many Requests")
        if name.startswith("boom"):
            raise ValueError("boom")
        return "ocr " + name

    def chat(self, raw_ocr, limit_s):
        if self.name.startswith("bad"):
            return "{not json"
        return json.dumps({"business_name": self.name, "total": "$1.00"})


class Failing:
    def ocr(self, record, limit_s):
        return None

    def chat(self, raw_ocr, limit_s):
        return None


class Steps:
    """Calls scripted as (seconds, answer or exception) per step."""

    def __init__(self, clock, ocr, chat=()):
        self.clock, self.script, self.limits = clock, {"ocr": list(ocr), "chat": list(chat)}, []

    def _next(self, step, limit_s):
        self.limits.append((step, limit_s))
        seconds, answer = self.script[step].pop(0)
        self.clock.t += seconds
        if isinstance(answer, Exception):
            raise answer
        return answer

    def ocr(self, record, limit_s):
        return self._next("ocr", limit_s)

    def chat(self, raw_ocr, limit_s):
        return self._next("chat", limit_s)


def files_df(spark, names):
    return spark.createDataFrame([(n, f"/data/{n}") for n in names], "file_name string, path string")


def test_status_per_behaviour(spark):
    names = ["ok1.jpg", "bad1.jpg", "none1.jpg", "slow1.jpg", "rate1.jpg", "boom1.jpg"]
    clock = Clock()
    att = extract(files_df(spark, names), Fake, run_id="r1", sleep=clock.sleep, clock=clock)
    got = {r.file_name: (r.status, r.error) for r in att.collect()}
    assert got == {"ok1.jpg": ("ok", None), "bad1.jpg": ("ok", None), "none1.jpg": ("failed", "ocr: no answer"),
                   "slow1.jpg": ("timeout", "ocr: too slow"), "rate1.jpg": ("ok", None), "boom1.jpg": ("error", "ocr: boom")}
    rows = {r.File_Name: r for r in to_result_rows(resolve_status(validate_receipts(att)), keep=["status"]).collect()}
    assert rows["bad1.jpg"].status == "bad_json" and rows["bad1.jpg"].Raw_OCR == "ocr bad1.jpg"
    assert rows["none1.jpg"].Extracted_JSON == "{}" and rows["none1.jpg"].Business_Name == ""
    assert rows["ok1.jpg"].Total == 1.0 and rows["ok1.jpg"].Business_Name == "ok1.jpg"


def test_retry_policy_by_step_and_error():
    rng = random.Random(1)
    for n, low in enumerate((31, 61, 121)):
        for step in ("ocr", "chat"):
            assert low <= retry_wait(n, f"{step}: 429", rng) <= low + 29
    assert retry_wait(3, "ocr: 429", rng) is None
    assert retry_wait(0, "ocr: 400 bad request", rng) == BAD_REQUEST_WAIT_S
    assert retry_wait(0, "chat: 400 bad request", rng) is None
    assert retry_wait(0, "ocr: 500", rng) is None


def test_plan_follows_the_policy(spark):
    rows = [("ocr: 429", 0, 40), ("chat: 429", 2, 130), ("ocr: 429", 3, None), ("ocr: 400", 1, 5), ("chat: 400", 0, None),
            ("chat: 500", 0, None), (None, 0, None)]
    df = spark.createDataFrame(rows, "error string, n int, want long").withColumn("at", F.lit("2020-01-01").cast("timestamp_ntz"))
    plan = retry_plan(F.col("error"), F.col("n"), F.col("at"), F.lit(10))
    for r in df.select("want", plan["wait_seconds"].alias("wait"), plan["give_up"].alias("give_up")).collect():
        assert r.wait == r.want and r.give_up == (r.want is None)


def test_each_call_has_its_own_limit_and_retries():
    clock, rng = Clock(), random.Random(0)
    steps = Steps(clock, [(3, RuntimeError("400")), (2, "text")], [(4, RuntimeError("429")), (1, "{}")])
    status, raw_ocr, response, spent, wall, error = run_one({}, steps, clock.sleep, clock, rng)
    assert (status, raw_ocr, response, error) == ("ok", "text", "{}", None)
    assert spent == 3 and wall == clock.t > 3 + 5 + 2 + 4 + 31  # answers only, and everything
    assert [s for s, _ in steps.limits] == ["ocr", "ocr", "chat", "chat"]
    assert steps.limits[0] == ("ocr", 60.0) and steps.limits[2] == ("chat", 90.0)


def test_a_late_answer_is_a_timeout():
    for script in ([(61, "text")], [(1, "text"), (91, "{}")]):
        clock = Clock()
        status, raw_ocr, response, _, _, error = run_one(
            {}, Steps(clock, script[:1], script[1:]), clock.sleep, clock, random.Random(0))
        assert status == "timeout" and response is None and "took" in error
    clock = Clock()
    steps = Steps(clock, [(50, RuntimeError("429"))] * 4)
    assert run_one({}, steps, clock.sleep, clock, random.Random(0))[0] == "timeout"  # no time for more retries
    assert clock.t <= 180


def test_workers_draw_waits_of_their_own(spark):
    class Waits(Fake):
        def ocr(self, record, limit_s):
            raise RuntimeError("429")

    clock = Clock()
    att = extract(files_df(spark, [f"f{i}.jpg" for i in range(8)]).repartition(4), Waits, run_id="r", sleep=clock.sleep, clock=clock)
    assert len({round(r.wall_time, 3) for r in att.collect()}) > 1


def test_a_retry_never_loses_to_an_older_failure(spark, tmp_path):
    log = str(tmp_path / "attempts")
    names = [f"ok{i}.jpg" for i in range(40)]
    append_attempts(extract(files_df(spark, names), Failing, run_id="r1", partitions=4, gap_s=None), log)
    latest = latest_attempts(load_attempts(spark, log))
    todo = pending_files(files_df(spark, names), latest)
    assert todo.count() == 40
    append_attempts(extract(todo.coalesce(1), Fake, run_id="r2", gap_s=None), log)
    latest = latest_attempts(load_attempts(spark, log))
    assert {r.status for r in latest.collect()} == {"ok"} and latest.count() == 40
    assert pending_files(files_df(spark, names), latest).count() == 0


def test_batch_job_resumes_and_calls_each_file_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Counting(Fake):
        def ocr(self, record, limit_s):
            calls.add(1)
            return super().ocr(record, limit_s)

    names = [f"ok{i}.jpg" for i in range(6)] + ["none1.jpg", "bad1.jpg"]
    folder, log = files_df(spark, names), str(tmp_path / "log")

    def stage(run):
        return lambda todo: extract(todo, Counting, run_id=run, gap_s=None)

    run_batch(spark, folder, stage("r1"), log, str(tmp_path / "one"), str(tmp_path / "skipped"), 0, 3, ["file_name"])
    assert calls.value == 3
    rows = run_batch(spark, folder, stage("r2"), log, str(tmp_path / "two"), str(tmp_path / "skipped2"))
    n = calls.value
    assert n == 3 + sum(1 for name in names if name not in sorted(names)[:3]) + sum(
        1 for name in sorted(names)[:3] if not name.startswith("ok"))
    assert {r.File_Name: r.Business_Name for r in rows.collect()} == {
        n: n if n.startswith("ok") else "" for n in names}
    assert calls.value == n  # results come from the log
    assert read_results(spark, str(tmp_path / "two")).count() == len(names)
    assert [r.value for r in spark.read.text(str(tmp_path / "skipped2")).collect()] == ["/data/none1.jpg"]
    done = done_files(load_attempts(spark, log))
    assert sorted(r.file_name for r in pending_files(folder, done).collect()) == ["bad1.jpg", "none1.jpg"]
    assert [r.path for r in skipped_paths(done).collect()] == ["/data/none1.jpg"]
    assert results_of(load_attempts(spark, log)).count() == len(names)


def test_offline_answers_read_the_layout(spark):
    text = "# Shop \"A\"\nDate: 2020-01-02\n2 x red pen $1.50\nnot an item\n10 x box $3.00\nSubtotal: $33.00\nTax: $0.00\nTotal: $33.00"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [json.loads(r[0]) for r in df.select(answer_of_text(F.col("t"))).collect()]
    assert got[0] == {"business_name": 'Shop "A"', "date": "2020-01-02", "items": [
        {"description": "red pen", "quantity": 2, "price": "$1.50"}, {"description": "box", "quantity": 10, "price": "$3.00"}],
        "subtotal": "$33.00", "tax": "$0.00", "total": "$33.00"}
    assert got[1] == got[2] == {"items": []}
    files = spark.createDataFrame([("a.jpg", "/a", text, False), ("b.jpg", "/b", text, True)], "file_name string, path string, ocr_text string, miss boolean")
    att = {r.file_name: r for r in extract_offline(files, "r", 3, failed=F.col("miss")).collect()}
    assert att["a.jpg"].status == "ok" and att["a.jpg"].run_seq == 3
    assert att["b.jpg"].status == "failed" and att["b.jpg"].response is None and att["b.jpg"].raw_ocr is None
