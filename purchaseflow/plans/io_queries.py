"""Queries over file names, result files, exports, media, prompts, the extraction
stage, the batch job and streaming ingest: q11, q23-q30, q32, q34-q37, q39, q40."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import data_url, mime_type, size_plan
from ..functions.text import (base_name, display_date, display_name, items_text, money,
                              money_or_na, money_or_zero, render_prompt)
from ..operators.extract import ExtractTimeout, extract, extract_offline
from ..operators.job import RESULT_PAYLOAD, results_of_state, run_batch
from ..operators.receipts import resolve_status, validate_receipts
from ..operators.runlog import CODEC, RunLog
from ..operators.state import latest_attempts, pending_from_results, skipped_paths, split_results
from ..schemas import RESULT_COLUMNS
from ..session import drop_scratch, scratch_path, shuffles_freed
from ..sinks.outputs import append_attempts, receipt_json, write_results, write_skipped
from ..sources.files import image_type_filter, slice_files
from ..sources.results import load_attempts, read_results
from ..streaming.ingest import ingest_once, read_ingested
from . import fixtures as fx

# SRC2 slice bounds of q26 (zero-based, half-open), as ``--start``/``--end`` would give.
SLICE_START, SLICE_END = 10, 60


def q11_file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11: base name (last path segment) of every page URL."""
    return fx.table(spark, sf_dir, "pages").select("page_id", base_name(F.col("url")).alias("file_name"))


def doc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result-schema rows built from ``documents`` with CSV-hostile content: pipes,
    quotes, backslashes, padding, blanks, nulls and whole multi-line texts."""
    d = fx.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    return d.select(
        F.concat(F.lit("doc"), k.cast("string"), F.lit(".jpg")).alias("File_Name"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.concat("source", F.lit(" | "), "lang")).alias("Business_Name"),
        F.concat(F.lit('  "'), "lang", F.lit('" \\ '), "source", F.lit("  ")).alias("Business_Address"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat("lang", F.lit("-"), "source")).alias("Date"),
        F.concat((k % 3).cast("string"), F.lit("x item|"), "lang").alias("Items"),
        (F.col("n_chars") / F.lit(100.0)).alias("Subtotal"),
        (k / F.lit(10.0)).alias("Tax"),
        F.col("n_chars").cast("double").alias("Total"),
        (k / F.lit(1000.0)).alias("Processing_Time_Seconds"),
        F.col("text").alias("Raw_OCR"),
        F.to_json(F.struct("doc_id", "lang")).alias("Extracted_JSON"))


def q23_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1 + SRC4: write the pipe-separated result file, read it back."""
    path = scratch_path(spark, "q23-results")
    write_results(doc_results(spark, sf_dir), path)
    return read_results(spark, path, na_as_missing=False).select(*RESULT_COLUMNS)


def q24_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5/SNK6: the six-key export with nulls kept, parsed back."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))
    items = F.array(F.struct(F.col("o_orderstatus").alias("description"),
                             F.lit(1.0).alias("quantity"), F.col("o_totalprice").alias("price")))
    tax = F.when(k % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice"))
    js = receipt_json(name, F.date_format("o_orderdate", "dd-MM-yyyy"), items,
                      F.col("o_totalprice"), tax, F.col("o_totalprice"))
    schema = ("business_name string, date string, items array<struct<description:string,"
              "quantity:double,price:double>>, subtotal double, tax double, total double")
    back = o.select("o_orderkey", js.alias("json")).select(
        "o_orderkey", "json", F.from_json("json", schema).alias("r"))
    return back.select(
        "o_orderkey", F.col("r.business_name").alias("business_name"), F.col("r.date").alias("date"),
        F.size("r.items").alias("n_items"), F.col("r.subtotal").alias("subtotal"),
        F.col("r.tax").alias("tax"), F.col("r.total").alias("total"),
        F.size(F.json_object_keys("json")).alias("n_keys"),
        F.col("json").contains('"business_name" : null').alias("has_null_name"))


def q25_data_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN12: one-line base64 data URL of each document's bytes, MIME from its name."""
    d = fx.table(spark, sf_dir, "documents")
    name = fx.file_name_of(F.col("doc_id"))
    return d.select("doc_id", name.alias("file_name"),
                    data_url(F.encode("text", "UTF-8"), mime_type(name)).alias("data_url"))


def q26_file_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: rows [10, 60) of the pages ordered by URL (page id breaks ties)."""
    p = fx.table(spark, sf_dir, "pages").select("page_id", "url", base_name(F.col("url")).alias("file_name"))
    return slice_files(p, SLICE_START, SLICE_END, order=["url", "page_id"])


def q27_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN15 + FN16: display defaults and money text (both page forms)."""
    c = fx.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, F.lit("")).when(k % 11 == 1, F.lit(None).cast("string")).otherwise(F.col("c_name"))
    date = F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit("")).otherwise(F.col("c_mktsegment"))
    tax = F.when(k % 5 == 0, F.lit(0.0)).when(k % 5 == 1, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", display_name(name).alias("display_name"),
                    display_date(date).alias("display_date"),
                    money_or_zero(tax).alias("tax_app"), money_or_na(tax).alias("tax_main"),
                    money(F.col("c_acctbal")).alias("balance"))


def q28_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17: the extraction instruction around each document's whole text."""
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", render_prompt(F.col("text")).alias("prompt"))


def q29_size_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN19: resize plan for a 3 MB budget (size = n_chars KiB, sides from the id)."""
    d = fx.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    plan = size_plan(F.col("n_chars") * 1024, F.lit(1000) + k % 3000, F.lit(800) + k % 2000)
    return d.select("doc_id", plan["size_mb"].alias("size_mb"), plan["scale"].alias("scale"),
                    plan["new_width"].alias("new_width"), plan["new_height"].alias("new_height"))


def q30_extract_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENR2: OCR texts through the offline extractor, then validated like model answers."""
    r = resolve_status(validate_receipts(extract_offline(fx.f7_ocr(spark, sf_dir), "q30", 1)))
    return r.select("file_name", "status", "business_name", "date",
                    items_text(F.col("items"), validated=True).alias("items"), "subtotal", "tax", "total",
                    F.size("items").alias("n_items"))


class EchoExtractor:
    """A stand-in client for the extraction stage: the outcome follows the document's id."""

    def ocr(self, record: dict, limit_s: float) -> str | None:
        if record["doc_id"] % 10 == 7:
            raise ExtractTimeout("too slow")
        self.record = record
        return None if record["doc_id"] % 10 == 3 else record["text"]

    def chat(self, raw_ocr: str, limit_s: float) -> str | None:
        if self.record["doc_id"] % 10 == 5:
            raise RuntimeError("HTTP 500")
        if self.record["doc_id"] % 10 == 9:
            return "no json"
        return json.dumps({"business_name": self.record["source"], "total": len(raw_ocr)})


def q34_extract_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENR1: every document through the extraction stage, answers validated."""
    d = fx.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("file_name"),
        F.concat(F.lit("/data/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "source", "text")
    r = resolve_status(validate_receipts(extract(d, EchoExtractor, run_id="q34", run_seq=1, gap_s=None)))
    return r.select("file_name", "status", "error", "business_name", "total")


def q35_batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch job over OCR texts: a run in which every fifth file has no answer,
    its state compacted, then a run that extracts just those, submitted twice; the results
    derive from the snapshot and the second run.  The texts are put together once; both runs
    read them."""
    base, folder = scratch_path(spark, "q35-job"), scratch_path(spark, "q35-files")
    log = f"{base}/log"
    with shuffles_freed(spark):
        fx.f7_ocr(spark, sf_dir).write.option("compression", CODEC).parquet(folder)
    files = spark.read.parquet(folder)
    run_batch(spark, files, lambda todo: extract_offline(todo, "run1", 1, failed=F.col("o_orderkey") % 5 == 0),
              log, skipped_path=f"{base}/skipped", run_id="run1", run_seq=1)
    RunLog(spark, log).compact()
    for _ in range(2):
        run_batch(spark, files, lambda todo: extract_offline(todo, "run2", 2), log, run_id="run2", run_seq=2)
    drop_scratch(spark, folder)
    rows = results_of_state(RunLog(spark, log).state(RESULT_PAYLOAD), keep=["status", "n_attempts"])
    return rows.select(F.col("File_Name").alias("file_name"), "status", "n_attempts", F.col("Business_Name").alias("business_name"),
                       F.col("Date").alias("date"), F.col("Items").alias("items"), F.col("Subtotal").alias("subtotal"),
                       F.col("Tax").alias("tax"), F.col("Total").alias("total"))


def q36_csv_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL1 + REL2 by the result file: rows with blank names and NA tokens, rows outside the
    slice and files without a row; written, read back, split, and what is pending."""
    path = scratch_path(spark, "q36-results")
    k = F.col("doc_id")
    d = doc_results(spark, sf_dir).withColumn("doc_id", F.regexp_extract("File_Name", r"\d+", 0).cast("long"))
    name = (F.when(k % 5 == 0, F.lit("")).when(k % 7 == 1, F.lit("N/A")).when(k % 7 == 2, F.lit("null"))
            .otherwise(F.lit("Shop")))
    write_results(d.filter(k % 4 != 3).withColumn("Business_Name", name), path)
    files = fx.table(spark, sf_dir, "documents").filter(k % 3 != 0).select(
        F.concat(F.lit("doc"), k.cast("string"), F.lit(".jpg")).alias("file_name"))
    rows = read_results(spark, path)
    states = split_results(rows, files).select(F.col("File_Name").alias("file_name"), "state")
    pending = pending_from_results(files, rows).withColumn("pending", F.lit(True))
    return (states.join(pending, "file_name", "full")
            .select("file_name", "state", F.coalesce("pending", F.lit(False)).alias("pending")))


def q37_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2/SNK3 + SRC6: the attempt log appended in two batches and loaded."""
    path = scratch_path(spark, "q37-log")
    att = fx.f6_attempts(spark, sf_dir)
    append_attempts(att.filter(F.col("attempt_seq") % 2 == 0), path)
    append_attempts(att.filter(F.col("attempt_seq") % 2 == 1), path)
    return load_attempts(spark, path).select("run_id", "attempt_seq", "file_name", "path", "status", "error",
                                             "processing_time", "wall_time")


def q39_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3: names with an image suffix, in any case."""
    suffixes = F.array(*map(F.lit, [".jpg", ".JPEG", ".png", ".gif", ""]))
    p = fx.table(spark, sf_dir, "pages").select("page_id", F.concat(
        base_name(F.col("url")), suffixes[(F.col("page_id") % 5).cast("int")]).alias("file_name"))
    return image_type_filter(p)


def q40_skipped_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: the skipped list written and read back."""
    path = scratch_path(spark, "q40-skipped")
    latest = latest_attempts(fx.f6_attempts(spark, sf_dir), order=["attempt_seq"], payload=["status", "path"])
    write_skipped(skipped_paths(latest), path)
    return spark.read.text(path).withColumnRenamed("value", "path")


def q32_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: the attempt log lands in a folder in two commits; three ``availableNow``
    passes ingest it -- the second picks up only the new files, the third nothing."""
    base = scratch_path(spark, "q32-ingest")
    src, sink, ck = f"{base}/source", f"{base}/sink", f"{base}/checkpoint"
    att = fx.f6_attempts(spark, sf_dir)
    schema = att.schema
    att.filter(F.col("attempt_seq") % 2 == 0).write.mode("append").parquet(src)
    ingest_once(spark, src, sink, ck, 1, fmt="parquet", schema=schema, glob="*.parquet")
    att.filter(F.col("attempt_seq") % 2 == 1).write.mode("append").parquet(src)
    ingest_once(spark, src, sink, ck, 2, fmt="parquet", schema=schema, glob="*.parquet")
    ingest_once(spark, src, sink, ck, 3, fmt="parquet", schema=schema, glob="*.parquet")
    return read_ingested(spark, sink).select("file_name", "attempt_seq", "status", "ingest_run")
