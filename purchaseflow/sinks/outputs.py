"""Sinks: result file (SNK1), attempt-log append (SNK2/SNK3), skipped list (SNK4),
JSON export (SNK5; SNK6 is :func:`purchaseflow.operators.receipts.extracted_json`).

The reference rewrites its whole CSV after every record (quadratic bytes) and pickles
all results per record; here attempts are appended once per batch and the result
file is materialised once from the latest state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..schemas import ATTEMPTS, RESULT_COLUMNS
from ..session import drop_scratch, scratch_path, shuffles_freed
from ..sources.results import CSV_OPTIONS

# Writer options: keep leading/trailing blanks (the CSV writer trims by default).
WRITE_OPTIONS = {**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"},
                 "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


# A quoted field may hold line breaks, so a file is read back by one task: files are small.
RECORDS_PER_FILE = 20_000


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: the result rows as pipe-separated text with a header, fields quoted when
    needed (embedded ``|``, quotes, line breaks), in files of bounded size.  Write to a
    fresh location: Spark cannot overwrite a path it is reading."""
    (results.select(*RESULT_COLUMNS).write.mode(mode).option("maxRecordsPerFile", RECORDS_PER_FILE)
     .options(**WRITE_OPTIONS).csv(path))


def append_attempts(attempts: DataFrame, path: str) -> None:
    """SNK2/SNK3: append a batch of attempts to the log (one commit per batch)."""
    attempts.select(*[f.name for f in ATTEMPTS.fields]).write.mode("append").parquet(path)


def write_skipped(skipped: DataFrame, path: str) -> bool:
    """SNK4: one path per line; nothing is written when there is no skipped file.
    Returns whether anything was written.  The input is evaluated once."""
    spark, seen = skipped.sparkSession, Observation()
    draft = scratch_path(spark, "skipped")
    with shuffles_freed(spark):
        skipped.select("path").observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(draft)
    if seen.get["n"]:
        spark.read.schema("path string").parquet(draft).write.mode("overwrite").text(path)
    drop_scratch(spark, draft)
    return seen.get["n"] > 0


def receipt_json(business_name: Column, date: Column, items: Column, subtotal: Column,
                 tax: Column, total: Column, pretty: bool = True) -> Column:
    """SNK5: the six-key receipt export with nulls kept (indented when ``pretty``)."""
    opts = {"ignoreNullFields": "false"}
    if pretty:
        opts["pretty"] = "true"
    return F.to_json(F.struct(business_name.alias("business_name"), date.alias("date"),
                              items.alias("items"), subtotal.alias("subtotal"),
                              tax.alias("tax"), total.alias("total")), opts)
