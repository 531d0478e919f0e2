"""Queries over receipt responses and line text: q01-q10 (scalars, validation, items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_value, standardize_date
from ..functions.price import clean_price, strict_price
from ..functions.quantity import normalize_quantity, strict_quantity
from ..functions.text import items_text, strip_text
from ..functions.variants import with_parsed
from ..operators.receipts import (explode_response_items, resolve_status, sum_item_prices, to_result_rows,
                                  validate_receipts)
from . import fixtures as fx

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def q01_price_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1 over a JSON-typed price (text forms and bare numbers)."""
    f2 = with_parsed(fx.f2_line_text(spark, sf_dir), "price_json")
    return f2.select(*LINE_KEY, clean_price(F.col("_v")).alias("price"))


def q02_price_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN2 over the price text; null where the reference raises."""
    f2 = fx.f2_line_text(spark, sf_dir)
    return f2.select(*LINE_KEY, strict_price(F.col("price_text")).alias("price"))


def q03_date_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN3 over the 12 ladder renderings of the order date."""
    o = fx.table(spark, sf_dir, "orders")
    # the rendered text is its own column: the ladder reads it many times
    texts = o.select("o_orderkey", fx.render_f3(F.col("o_orderkey"), F.col("o_orderdate")).alias("t"))
    std = texts.select("o_orderkey", standardize_date(F.col("t")).alias("date"))
    return std.select("o_orderkey", "date", date_value(F.col("date")).alias("date_value"))


def q04_date_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4 over odd renderings (time suffix, two-digit year, short month, blank)."""
    o = fx.table(spark, sf_dir, "orders")
    texts = o.select("o_orderkey", fx.render_f4(F.col("o_orderkey"), F.col("o_orderdate")).alias("t"))
    return texts.select("o_orderkey", standardize_date(F.col("t")).alias("date"))


def q05_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5 (lenient, typed) and FN6 (strict, on the text form) of the quantity value."""
    f2 = with_parsed(fx.f2_line_text(spark, sf_dir), "quantity_json")
    v = F.col("_v")
    q = normalize_quantity(v)
    as_text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")) \
        .when(F.is_variant_null(v), F.lit("None")).otherwise(F.to_json(v))
    return f2.select(*LINE_KEY, q["quantity"].alias("quantity"), q["quantity_text"].alias("quantity_text"),
                     strict_quantity(as_text).alias("strict_quantity"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 responses validated (status resolved against the parse)."""
    return resolve_status(validate_receipts(fx.f1_receipts(spark, sf_dir)))


def q06_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: model responses -> validated, normalised result rows."""
    rows = to_result_rows(receipts(spark, sf_dir), keep=["status"])
    js = F.col("Extracted_JSON")
    # The JSON column is compared by its values: key order and number text may differ.
    return rows.select(
        *[c for c in rows.columns if c != "Extracted_JSON"],
        F.get_json_object(js, "$.business_name").alias("json_name"),
        F.get_json_object(js, "$.currency").alias("json_currency"),
        F.get_json_object(js, "$.total").cast("double").alias("json_total"),
        F.json_array_length(F.get_json_object(js, "$.items")).alias("json_items"),
        F.size(F.json_object_keys(js)).alias("json_keys"))


def q07_items_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13 per receipt."""
    r = receipts(spark, sf_dir)
    return r.select("file_name", items_text(F.col("items"), validated=True).alias("items"),
                    F.size("items").alias("n_items"))


def q08_items_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REL8 + FN14: one row per valid item with its line total."""
    rows = explode_response_items(fx.f1_receipts(spark, sf_dir), ["file_name"])
    return rows.withColumn(
        "line_total", F.when(F.col("quantity") > 1e6, F.col("line_total")).otherwise(F.round("line_total", 2)))


def q09_sum_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1: sum of item prices per receipt (quantity ignored), 0 when none."""
    r = receipts(spark, sf_dir)
    return r.select("file_name", F.round(sum_item_prices(F.col("items")), 2).alias("sum_price"))


def q10_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN7 + REL6: stripped descriptions, blank ones removed."""
    f2 = fx.f2_line_text(spark, sf_dir, with_description=True)
    d = strip_text(F.col("description_raw"))
    return f2.select(*LINE_KEY, d.alias("description")).filter(F.col("description") != "")
