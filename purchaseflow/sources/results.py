"""Read prior results (SRC4, SRC5) and the attempt log (SRC6); parse responses
(SRC7 lives in :mod:`purchaseflow.operators.receipts`, SRC8 in
:mod:`purchaseflow.operators.labelled`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ATTEMPTS, RESULTS
from .quoted import read_fields

# The pipe-separated result file format.
CSV_OPTIONS = {"sep": "|", "header": "true", "quote": '"', "escape": '"', "multiLine": "true"}

# Tokens a pandas CSV reader turns into NaN by default; a field equal to
# one of them reads back as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def _size(spark: SparkSession, path: str) -> int | None:
    """Bytes under ``path``; None when it does not exist."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(where).getLength() if fs.exists(where) else None


def read_results(spark: SparkSession, path: str, na_as_missing: bool = True) -> DataFrame:
    """SRC4/SRC5: the pipe-separated result file(s) at ``path``: the declared columns, found
    by their names in each file's own header (a column a file does not have is null), plus
    ``bad_fields``, the names of the amounts whose text is no number ('' for none).  A large
    file is read by many tasks (:mod:`purchaseflow.sources.quoted`).

    Only a missing or empty location counts as a fresh start and gives an empty frame;
    anything else that cannot be read is an error.  ``na_as_missing``: every field that
    holds an NA token is missing."""
    if not _size(spark, path):
        return spark.createDataFrame([], RESULTS).withColumn("bad_fields", F.lit(""))
    raw = read_fields(spark, path, [f.name for f in RESULTS.fields], CSV_OPTIONS)

    def text(name: str):
        return F.when(~F.col(name).isin(NA_TOKENS), F.col(name)) if na_as_missing else F.col(name)

    amounts = [f.name for f in RESULTS.fields if isinstance(f.dataType, T.DoubleType)]
    columns = [(text(f.name).try_cast("double") if f.name in amounts else text(f.name)).alias(f.name) for f in RESULTS.fields]
    bad = F.array_join(F.array(*[F.when(text(n).isNotNull() & text(n).try_cast("double").isNull(), F.lit(n)) for n in amounts]), ",")
    return raw.select(*columns, bad.alias("bad_fields"))


def load_attempts(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: the attempt log, or an empty frame when there is none yet.  Of a log of published
    runs, the attempts of those."""
    if not _size(spark, path):
        return spark.createDataFrame([], ATTEMPTS)
    if _size(spark, f"{path}/manifests"):
        from ..operators.runlog import RunLog

        return RunLog(spark, path).attempts()
    return spark.read.schema(ATTEMPTS).parquet(path)
