"""Declared schemas: the result row, the attempt log, items and labelled responses."""

from __future__ import annotations

from pyspark.sql import types as T

# Result file columns, in the fixed output order of the batch job.
RESULTS = T.StructType([
    T.StructField("File_Name", T.StringType()),
    T.StructField("Business_Name", T.StringType()),
    T.StructField("Business_Address", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Items", T.StringType()),
    T.StructField("Subtotal", T.DoubleType()),
    T.StructField("Tax", T.DoubleType()),
    T.StructField("Total", T.DoubleType()),
    T.StructField("Processing_Time_Seconds", T.DoubleType()),
    T.StructField("Raw_OCR", T.StringType()),
    T.StructField("Extracted_JSON", T.StringType()),
])
RESULT_COLUMNS = [f.name for f in RESULTS.fields]

# Append-only attempt log: one row per extraction attempt of one file, in the order of
# (run_seq, attempt_seq).
ATTEMPTS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_seq", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("attempt_seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("raw_ocr", T.StringType()),
    T.StructField("response", T.StringType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("wall_time", T.DoubleType()),
    T.StructField("error", T.StringType()),
    T.StructField("attempted_at", T.TimestampNTZType()),
])

# Totals and times of a run, as its write counted them.
RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_seq", T.LongType()),
    T.StructField("n_attempts", T.LongType()),
    T.StructField("n_results", T.LongType()),
    T.StructField("n_skipped", T.LongType()),
    T.StructField("processing_time", T.DoubleType()),
    T.StructField("wall_time", T.DoubleType()),
])

CELL = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("text", T.StringType()),
])

FIELD = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("ocr_text", T.StringType()),
    T.StructField("cells", T.ArrayType(CELL)),
])

# Labelled-cell response body: {"result": [{"prediction": [field, ...]}, ...]}
LABELLED = T.StructType([
    T.StructField("result", T.ArrayType(T.StructType([
        T.StructField("prediction", T.ArrayType(FIELD)),
    ]))),
])
