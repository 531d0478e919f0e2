"""Extraction stage (ENR1-ENR5): the only step that calls out of the engine.

``extract`` runs an injected extractor over the partitions of a file frame with
``mapInPandas`` (Arrow batches in and out).  The extractor is built once per partition by
``extractor_factory`` (for a model client: one client per task) and has two calls, as the
record has two steps: ``ocr(record, limit_s)`` and ``chat(raw_ocr, limit_s)``.  Each call
is told the seconds it may take and must give up by itself (``ExtractTimeout``); a call
cannot be interrupted from outside.

Per record the stage keeps a random gap to the one before, retries each call by the retry
policy, turns limits and errors into a status with the error's text, and reports two
times: of the calls that counted, and of everything since the record began.  Rows leave
the stage every few records, and partitions are small, so a lost task repeats few calls.
How many tasks run at once is the cluster's business: give ``extract`` a resource profile
whose tasks claim as many cores as the rate limit asks for.

The attempt rows are meant to be appended to the log first and everything else derived
from the log (:mod:`purchaseflow.operators.job`), so a recomputation never calls the
extractor twice for a committed batch.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..schemas import ATTEMPTS
from ..session import ship_package

# The limits and the retry policy of a record.
RECORD_LIMIT_S = 180.0
STEP_LIMIT_S = {"ocr": 60.0, "chat": 90.0}
MAX_RETRIES = 3
RATE_LIMIT_BASE_S = 30
RATE_LIMIT_JITTER_S = (1, 30)
BAD_REQUEST_WAIT_S = 5
GAP_S = (2, 5)

# Rows per output batch: what a failing task repeats at most, besides its last record.
CHUNK = 16


class Extractor(Protocol):
    """The two external calls of a record; each returns None when it has no answer."""

    def ocr(self, record: dict, limit_s: float) -> str | None: ...

    def chat(self, raw_ocr: str, limit_s: float) -> str | None: ...


class ExtractTimeout(Exception):
    """Raised by an extractor (or the stage) when a call runs past its limit."""


class StepError(Exception):
    """A call failed for good; the text starts with the step's name."""


def retry_wait(retry_no: int, error: str, rng: random.Random) -> float | None:
    """ENR4: seconds to wait before retry ``retry_no`` (0-based) of a call, or None when
    the error is final.  ``error`` is ``<step>: <message>``: a 429 is retried in either
    step, a 400 only in the first."""
    if retry_no >= MAX_RETRIES:
        return None
    if "429" in error:
        return (2 ** retry_no) * RATE_LIMIT_BASE_S + rng.randint(*RATE_LIMIT_JITTER_S)
    if error.startswith("ocr:") and "400" in error:
        return BAD_REQUEST_WAIT_S
    return None


def _call(step: str, call: Callable[[float], str | None], until: float, sleep: Callable[[float], None],
          clock: Callable[[], float], rng: random.Random) -> tuple[str | None, float]:
    """One step with its own retries -> its answer and the seconds of the call that gave it."""
    retry_no = 0
    while True:
        begin = clock()
        limit = min(STEP_LIMIT_S[step], until - begin)
        if limit <= 0:
            raise ExtractTimeout(f"{step}: no time left")
        try:
            answer = call(limit)
        except ExtractTimeout as exc:
            raise ExtractTimeout(f"{step}: {exc}") from exc
        except Exception as exc:  # noqa: BLE001 - any error of the extractor is a status
            error = f"{step}: {exc}"
            wait = retry_wait(retry_no, error, rng)
            if wait is None:
                raise StepError(error) from exc
            if clock() + wait > until:
                raise ExtractTimeout(f"{error} (no time for a retry)") from exc
            sleep(wait)
            retry_no += 1
            continue
        took = clock() - begin
        if took > limit:
            raise ExtractTimeout(f"{step}: took {took:.1f} s")
        return answer, took


def run_one(record: dict, extractor: Extractor, sleep: Callable[[float], None], clock: Callable[[], float],
            rng: random.Random, limit_s: float = RECORD_LIMIT_S
            ) -> tuple[str, str | None, str | None, float, float, str | None]:
    """One record -> ``(status, raw_ocr, response, processing_time, wall_time, error)``.
    ``processing_time`` counts the calls that answered, ``wall_time`` also failed calls
    and waits."""
    start = clock()
    until, spent, raw_ocr = start + limit_s, 0.0, None

    def out(status: str, response: str | None = None, error: str | None = None):
        kept = raw_ocr if status == "ok" else None
        return status, kept, response, spent, clock() - start, error

    try:
        raw_ocr, took = _call("ocr", lambda s: extractor.ocr(record, s), until, sleep, clock, rng)
        spent += took
        if raw_ocr is None:
            return out("failed", error="ocr: no answer")
        response, took = _call("chat", lambda s: extractor.chat(raw_ocr, s), until, sleep, clock, rng)
        spent += took
        return out("failed", error="chat: no answer") if response is None else out("ok", response)
    except ExtractTimeout as exc:
        return out("timeout", error=str(exc))
    except StepError as exc:
        return out("error", error=str(exc))


def extract(files: DataFrame, extractor_factory: Callable[[], Extractor], run_id: str,
            run_seq: int | None = None, input_cols: list[str] | None = None, partitions: int | None = None,
            gap_s: tuple[float, float] | None = GAP_S, limit_s: float = RECORD_LIMIT_S,
            profile: ResourceProfile | None = None, sleep: Callable[[float], None] = time.sleep,
            clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """ENR1 (+ENR3-ENR5): attempt rows for every file of ``files``.

    ``files`` needs ``file_name`` and ``path``; ``input_cols`` (default: all columns) are
    handed to the extractor as a dict per record.  An attempt's place in the log is
    (``run_seq``, ``attempt_seq``): ``run_seq`` is the run's start in milliseconds unless
    given, so a later run always comes after an earlier one, and ``attempt_seq`` is unique
    within the run.  ``partitions`` cuts the work in many small tasks; ``gap_s`` bounds the
    random gap between two records of a task; ``profile`` limits how many run at once.
    """
    cols = input_cols or files.columns
    ship_package(files.sparkSession)
    run_no = int(time.time() * 1000) if run_seq is None else run_seq
    spread = files.repartition(partitions) if partitions else files
    numbered = spread.select(*cols, F.monotonically_increasing_id().alias("_seq"))
    names = [f.name for f in ATTEMPTS.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = extractor_factory()
        # Every task of every run draws waits of its own.
        rng = random.Random(f"{run_id}/{run_no}/{TaskContext.get().partitionId()}")
        first, rows = True, []
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                if not first and gap_s:
                    sleep(rng.uniform(*gap_s))
                first = False
                status, raw_ocr, response, spent, wall, error = run_one(
                    {k: rec[k] for k in cols}, extractor, sleep, clock, rng, limit_s)
                rows.append((run_id, run_no, rec["file_name"], rec["path"], int(rec["_seq"]), status, raw_ocr, response,
                             spent, wall, error, pd.Timestamp.now(tz="UTC").tz_localize(None)))
                if len(rows) == CHUNK:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return numbered.mapInPandas(run, ATTEMPTS, profile=profile)


def retry_plan(error: Column, retry_no: Column, attempted_at: Column, jitter: Column) -> Column:
    """ENR4 as a plannable column, with the same rules as :func:`retry_wait`:
    ``struct(wait_seconds, next_attempt_at, give_up)``, so retries become a later batch
    instead of a blocked task.  ``give_up``: the error is final or retries are used up."""
    limited = F.coalesce(error.contains("429"), F.lit(False))
    bad_request = F.coalesce(error.startswith("ocr:") & error.contains("400"), F.lit(False))
    left = retry_no < MAX_RETRIES
    wait = (F.when(left & limited, (F.pow(F.lit(2), retry_no) * RATE_LIMIT_BASE_S + jitter).cast("bigint"))
            .when(left & bad_request, F.lit(BAD_REQUEST_WAIT_S).cast("bigint")))
    return F.struct(wait.alias("wait_seconds"),
                    (attempted_at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).alias("next_attempt_at"),
                    wait.isNull().alias("give_up"))


# ---------------------------------------------------------------- offline extractor

def answer_of_text(text: Column) -> Column:
    """ENR2: a model stand-in in columns.  It reads the OCR markdown layout (``# name``,
    ``Date:``, ``<qty> x <description> $<price>`` lines, ``Subtotal:``, ``Tax:``,
    ``Total:``) and answers with the JSON that the prompt asks for; keys that the text
    does not have stay out."""
    item = r"^(\d+) x (.+) (\$\d+\.\d{2})$"

    def after(prefix: str, lines: Column) -> Column:
        """What follows a prefix, on the lines that have it."""
        return F.transform(F.filter(lines, lambda x: x.startswith(prefix)),
                           lambda x: F.substring(x, F.lit(len(prefix) + 1), F.length(x)))

    def read(lines: Column) -> Column:
        last = lambda label: F.try_element_at(after(f"{label}: ", lines), F.lit(-1))
        items = F.transform(F.filter(lines, lambda x: x.rlike(item)), lambda x: F.struct(
            F.regexp_extract(x, item, 2).alias("description"),
            F.regexp_extract(x, item, 1).cast("bigint").alias("quantity"),
            F.regexp_extract(x, item, 3).alias("price")))
        return F.struct(F.try_element_at(after("# ", lines), F.lit(1)).alias("business_name"), last("Date").alias("date"),
                        items.alias("items"), last("Subtotal").alias("subtotal"), last("Tax").alias("tax"),
                        last("Total").alias("total"))

    # The lines are cut once: inside the lambda they are a variable.
    return F.to_json(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n")), read)[0])


def extract_offline(files: DataFrame, run_id: str, run_seq: int, text_col: str = "ocr_text",
                    failed: Column | None = None) -> DataFrame:
    """Attempt rows of the offline extractor, all in columns: ``failed`` marks records
    whose call has no answer."""
    miss = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    text = F.when(~miss, F.coalesce(F.col(text_col), F.lit("")))
    values = {
        "run_id": F.lit(run_id), "run_seq": F.lit(run_seq).cast("long"), "file_name": F.col("file_name"), "path": F.col("path"),
        "attempt_seq": F.monotonically_increasing_id(), "status": F.when(miss, F.lit("failed")).otherwise(F.lit("ok")),
        "raw_ocr": text, "response": F.when(~miss, answer_of_text(F.col(text_col))),
        "processing_time": F.lit(0.0), "wall_time": F.lit(0.0), "error": F.when(miss, F.lit("ocr: no answer")),
        "attempted_at": F.localtimestamp()}
    return files.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ATTEMPTS.fields])
