"""Dirty inputs derived from the driver tables (FIXTURES.md section 2).

Every fixture is a Spark plan over the given parquet tables, so its size grows with
them.  Dirt is assigned by key arithmetic so each expected value has a closed form
that the DuckDB oracles compute from the base columns without reusing the cleaning
code.

Grain notes for scale:
* F2 (line text) is row-local: a projection of ``lineitem`` without an exchange.
* F1/F5/F7 are one document per order.  Lines are pre-aggregated with
  ``collect_list`` (partial aggregation on the map side), the order side is joined on
  ``o_orderkey``; a document is by definition one row, so its size is the size of one
  receipt.  Item positions come from the sorted line array, so no window over the
  order key is needed.
* F6 (attempt log) is a map-only projection of ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The 12 ladder formats rendered with two-digit day and month (F3),
# in ladder order; index = order key % 12.
F3_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy",
              "MMMM dd, yyyy", "dd MMMM yyyy", "MM/dd/yy", "dd/MM/yy", "yyyy/MM/dd",
              "dd.MM.yyyy", "MM.dd.yyyy"]
# Error texts of failed attempts (F6); index = event id % 4.
F6_ERRORS = ["ocr: HTTP 429 Too Many Requests", "ocr: HTTP 400 Bad Request", "chat: HTTP 400 Bad Request",
             "chat: HTTP 500 Server Error"]
# Odd date renderings for the fallback (F4); index = order key % 6.
F4_FORMATS = ["MM/dd/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm", "MM-dd-yy", "dd-MM-yy", "MMM d, yyyy", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- text helpers

def json_str(c: Column) -> Column:
    """JSON string literal of ``c``: the JSON writer escapes it inside a one-element
    array, whose brackets are then trimmed (the literal itself starts and ends with
    a quote, so only the brackets go)."""
    return F.btrim(F.to_json(F.array(c)), F.lit("[]"))


def cents_of(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def cents_text(cents: Column) -> Column:
    """``d.cc`` from integer cents, without ever printing a double."""
    return F.concat(F.floor(cents / 100).cast("string"),
                    F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def cents_text_grouped(cents: Column) -> Column:
    """``d,ddd.cc`` (thousands separators) from integer cents."""
    whole = F.format_number(F.floor(cents / 100), 0)
    return F.concat(whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def file_name_of(key: Column) -> Column:
    """The key, padded to 9 digits at least, plus an image suffix chosen by key % 3.
    A longer key keeps all its digits, so no two keys share a name."""
    ext = F.when(key % 3 == 0, F.lit(".jpg")).when(key % 3 == 1, F.lit(".jpeg")).otherwise(F.lit(".png"))
    text = key.cast("string")
    return F.concat(F.lpad(text, F.greatest(F.lit(9), F.length(text)), F.lit("0")), ext)


def shared_file_name_of(key: Column) -> Column:
    """:func:`file_name_of`, except that every 32nd document repeats another's name."""
    return file_name_of(F.when(key % 32 == 7, key - 1).otherwise(key))


def render_f3(key: Column, d: Column) -> Column:
    out = F.lit(None).cast("string")
    for i in reversed(range(12)):
        out = F.when(key % 12 == i, F.date_format(d, F3_FORMATS[i])).otherwise(out)
    return out


def render_f4(key: Column, d: Column) -> Column:
    out = F.lit("")
    for i in reversed(range(5)):
        out = F.when(key % 6 == i, F.date_format(d, F4_FORMATS[i])).otherwise(out)
    return out


# ---------------------------------------------------------------- per-order lines

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order that has lines: ``lines`` = lines sorted by
    (linenumber, partkey, suppkey, quantity, cents) with part name and price in cents,
    plus the cents total.  The position in ``lines`` is the line rank ``rn``."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        cents_of(F.col("l_extendedprice")).alias("cents"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = li.join(part, "l_partkey")
    return lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
                                             "l_quantity", "cents", "p_name"))).alias("lines"),
        F.sum("cents").alias("line_cents"))


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (all of them) with customer columns and their line array (empty when none)."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name",
                                                "c_mktsegment")
    ol = order_lines(spark, sf_dir).withColumnRenamed("l_orderkey", "o_orderkey")
    empty = F.array().cast(ol.schema["lines"].dataType)
    return (o.join(c, "o_custkey", "left").join(ol, "o_orderkey", "left")
            .withColumn("lines", F.coalesce("lines", empty))
            .withColumn("line_cents", F.coalesce("line_cents", F.lit(0).cast("bigint"))))


# ---------------------------------------------------------------- F1 receipts

def _f1_item(x: Column, i: Column) -> Column:
    rn = i + 1
    q = x["l_quantity"].cast("bigint").cast("string")
    blank = x["l_partkey"] % 17 == 0
    desc = (F.when(blank, F.lit("  "))
            .when(rn % 3 == 1, F.concat(F.lit("\t"), x["p_name"], F.lit(" ")))
            .otherwise(x["p_name"]))
    two = F.lpad(q, 2, "0")
    code = x["l_partkey"] % 8
    qty = (F.when(code == 0, q)
           .when(code == 1, json_str(F.concat(q, F.lit("x"))))
           .when(code == 2, F.lit("null"))
           .when(code == 3, json_str(F.concat(q, F.lit(".0 kg"))))
           .when(code == 4, F.concat(q, F.lit(".0")))
           .when(code == 5, F.concat(F.lit("90071992547410"), two))     # beyond 2^53
           .when(code == 6, F.concat(F.lit("123456"), two, F.lit(".5")))  # beyond 1e7
           .otherwise(F.concat(F.lit("0.0005"), two)))                  # below 1e-3
    c = x["cents"]
    price = (F.when(rn % 4 == 0, cents_text(c))
             .when(rn % 4 == 1, json_str(F.concat(F.lit("$"), cents_text(c))))
             .when(rn % 4 == 2, json_str(F.concat(cents_text(c), F.lit(" USD"))))
             .otherwise(json_str(F.concat(F.lit("$"), cents_text_grouped(c)))))
    return F.concat(F.lit('{"description": '), json_str(desc), F.lit(', "quantity": '), qty,
                    F.lit(', "price": '), price, F.lit("}"))


def f1_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one model response per order -> ``file_name, o_orderkey, response, raw_ocr,
    processing_time, status``."""
    k = F.col("o_orderkey")
    name = (F.when(k % 11 == 0, F.lit('"business_name": "", '))
            .when(k % 11 == 1, F.lit(""))
            .when(k % 11 == 2, F.lit('"business_name": null, '))
            .when(k % 11 == 3, F.lit('"business_name": "N/A", '))
            .otherwise(F.concat(F.lit('"business_name": '), json_str(F.col("c_name")), F.lit(", "))))
    address = F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(
        F.lit('"business_address": '),
        json_str(F.concat(F.lit("Unit "), F.col("o_custkey").cast("string"), F.lit(", "),
                          F.col("c_mktsegment"))), F.lit(", ")))
    date = F.concat(F.lit('"date": '), json_str(render_f3(k, F.col("o_orderdate"))), F.lit(", "))
    item_texts = F.transform(F.col("lines"), _f1_item)
    item_texts = F.when(k % 13 == 4, F.array_append(item_texts, F.lit('"see reverse"'))).otherwise(item_texts)
    items = F.when(k % 53 == 7, F.lit('"items": {"description": "boxed set", "price": 1}, ')).otherwise(
        F.concat(F.lit('"items": ['), F.array_join(item_texts, ", "), F.lit("], ")))
    sub = cents_text(F.col("line_cents"))
    subtotal = F.concat(F.lit('"subtotal": '),
                        F.when(k % 2 == 0, json_str(sub)).otherwise(sub), F.lit(", "))
    total_cents = cents_of(F.col("o_totalprice"))
    tax = F.concat(F.lit('"tax": '), F.when(k % 5 == 0, F.lit('"FREE"')).otherwise(
        cents_text(total_cents % 10000)), F.lit(", "))
    total = F.concat(F.lit('"total": '), json_str(F.concat(F.lit("$"), cents_text(total_cents))))
    doc = F.concat(F.lit("{"), name, address, date, items, subtotal, tax, total,
                   F.lit(', "currency": "USD"}'))
    response = (F.when(k % 97 == 5, F.substring(doc, 1, 25))
                .when(k % 97 == 6, F.lit("[]"))
                .otherwise(doc))
    return orders_with_lines(spark, sf_dir).select(
        file_name_of(k).alias("file_name"), "o_orderkey",
        response.alias("response"),
        F.concat(F.lit("# receipt "), k.cast("string")).alias("raw_ocr"),
        ((k % 1000) / F.lit(100.0)).alias("processing_time"),
        F.lit("ok").alias("status"))


# ---------------------------------------------------------------- F2 line text

def line_code(prefix: str = "l_") -> Column:
    """Row-local dirt code of a line (no window needed)."""
    return (F.col(f"{prefix}orderkey") + F.col(f"{prefix}linenumber") + F.col(f"{prefix}partkey")
            + F.col(f"{prefix}suppkey"))


def f2_line_text(spark: SparkSession, sf_dir: str, with_description: bool = False) -> DataFrame:
    """per lineitem row, a price value (JSON text), a quantity value (JSON text)
    and (when asked, via the part join) a padded description;
    ``code = orderkey + linenumber + partkey + suppkey``."""
    li = table(spark, sf_dir, "lineitem")
    code = line_code()
    cents = cents_of(F.col("l_extendedprice"))
    ct = cents_text(cents)
    price_text = (F.when(code % 8 == 0, F.lit("FREE"))
                  .when(code % 8 == 1, F.concat(F.lit("$"), ct))
                  .when(code % 8 == 2, F.concat(ct, F.lit(" USD")))
                  .when(code % 8 == 3, F.lit("N/A"))
                  .when(code % 8 == 4, F.concat(F.lit("$"), cents_text_grouped(cents)))
                  .when(code % 8 == 5, F.concat(F.lit("-"), ct))
                  .when(code % 8 == 6, F.concat(ct, F.lit(".00")))
                  .otherwise(ct))
    price_json = F.when(code % 8 == 7, ct).otherwise(json_str(price_text))
    q = F.col("l_quantity").cast("bigint").cast("string")
    two = F.lpad(q, 2, "0")
    qty_json = (F.when(code % 10 == 0, q)
                .when(code % 10 == 1, json_str(F.concat(q, F.lit("x"))))
                .when(code % 10 == 2, json_str(F.concat(q, F.lit(".0 kg"))))
                .when(code % 10 == 3, F.lit('""'))
                .when(code % 10 == 4, F.lit("null"))
                .when(code % 10 == 5, F.lit('"abc"'))
                .when(code % 10 == 6, F.concat(F.lit("90071992547410"), two))     # beyond 2^53
                .when(code % 10 == 7, F.concat(F.lit("123456"), two, F.lit(".5")))  # beyond 1e7
                .when(code % 10 == 8, F.concat(F.lit("0.0005"), two))             # below 1e-3
                .otherwise(json_str(F.concat(F.lit("123456"), two, F.lit(".5 kg")))))
    desc = (F.when(F.col("l_partkey") % 17 == 0, F.lit(" \t "))
            .when(code % 3 == 0, F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n")))
            .when(code % 3 == 1, F.concat(F.col("p_name"), F.lit("  ")))
            .otherwise(F.col("p_name")))
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            price_text.alias("price_text"), price_json.alias("price_json"),
            qty_json.alias("quantity_json")]
    if not with_description:
        return li.select(*cols)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return li.join(part, "l_partkey").select(*cols, desc.alias("description_raw"))


# ---------------------------------------------------------------- F5 labelled cells

def _f5_cells(x: Column, i: Column) -> Column:
    rn = (i + 1).cast("string")
    q = x["l_quantity"].cast("bigint").cast("string")

    def cell(label, text):
        return F.concat(F.lit('{"label": "' + label + '", "row": '), rn, F.lit(', "text": '),
                        json_str(text), F.lit("}"))
    desc = cell("Description", x["p_name"])
    price = cell("Price", F.concat(F.lit("$"), cents_text(x["cents"])))
    second = cell("Price", F.lit("9.99"))
    qty = cell("Quantity", q)
    parts = F.array(desc)
    parts = F.when((i + 1) % 5 == 0, parts).otherwise(F.array_append(parts, price))
    parts = F.when((i + 1) % 4 == 0, F.array_append(parts, second)).otherwise(parts)
    return F.array_join(F.array_append(parts, qty), ", ")


def f5_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one labelled-cell response per order -> ``file_name, o_orderkey, body``.  Some
    documents share a file name; ``o_orderkey`` is the document."""
    k = F.col("o_orderkey")
    total_cents = cents_of(F.col("o_totalprice"))

    def field(label, text):
        return F.concat(F.lit('{"label": "' + label + '", "ocr_text": '), json_str(text), F.lit("}"))
    cells = F.array_join(F.transform(F.col("lines"), _f5_cells), ", ")
    table_field = F.concat(F.lit('{"label": "table", "cells": ['), cells, F.lit("]}"))
    fields = F.concat_ws(", ",
                         field("Merchant_Name", F.concat(F.lit("Store "), F.col("o_custkey").cast("string"))),
                         field("Date", F.date_format("o_orderdate", "yyyy-MM-dd")),
                         F.when(F.size("lines") > 0, table_field),
                         field("Tax_Amount", F.concat(F.lit("$"), cents_text(total_cents % 10000))),
                         field("Merchant_Name", F.col("c_name")),
                         field("Total_Amount", F.concat(F.lit("$"), cents_text(total_cents))))
    body = F.concat(F.lit('{"result": [{"prediction": ['), fields, F.lit("]}]}"))
    return orders_with_lines(spark, sf_dir).select(
        shared_file_name_of(k).alias("file_name"), "o_orderkey", body.alias("body"))


# ---------------------------------------------------------------- F6 attempt log

def f6_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an attempt log in the ATTEMPTS schema: one run a day, sequence
    numbers unique over all runs, an error text for attempts that failed."""
    e = table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type").isin("purchase", "view"), F.lit("ok"))
              .when(F.col("event_type") == "signup", F.lit("bad_json"))
              .when(F.col("event_type") == "click", F.lit("timeout"))
              .otherwise(F.lit("failed")))
    fname = F.concat(F.lit("r"), F.col("user_id").cast("string"), F.lit(".jpg"))
    errors = F.array(*map(F.lit, F6_ERRORS))
    error = (F.when(status == "failed", errors[(F.col("event_id") % len(F6_ERRORS)).cast("int")])
             .when(status == "timeout", F.lit("chat: no time left")))
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("run_seq"),
        fname.alias("file_name"),
        F.concat(F.lit("/data/receipts/"), fname).alias("path"),
        F.col("event_id").alias("attempt_seq"),
        status.alias("status"),
        F.concat(F.lit("# "), F.col("event_type")).alias("raw_ocr"),
        F.col("props").alias("response"),
        F.col("value").alias("processing_time"),
        (F.col("value") * 2).alias("wall_time"),
        error.alias("error"),
        F.col("ts").alias("attempted_at"))


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 as two runs that both number their attempts from 0: even event ids are run 1."""
    k = F.col("attempt_seq")
    return f6_attempts(spark, sf_dir).withColumns(
        {"run_id": F.concat(F.lit("run"), (k % 2 + 1).cast("string")), "run_seq": k % 2 + 1,
         "attempt_seq": F.floor(k / 2).cast("long")})


def customer_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file folder of the state queries: one file per customer key."""
    fname = F.concat(F.lit("r"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "customer").select(
        fname.alias("file_name"), F.concat(F.lit("/data/receipts/"), fname).alias("path"))


# ---------------------------------------------------------------- F7 OCR text

def f7_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one OCR markdown text per order."""
    k = F.col("o_orderkey")
    total_cents = cents_of(F.col("o_totalprice"))
    item_lines = F.transform(F.col("lines"), lambda x: F.concat(
        x["l_quantity"].cast("bigint").cast("string"), F.lit(" x "), x["p_name"], F.lit(" $"),
        cents_text(x["cents"])))
    text = F.concat_ws("\n",
                       F.concat(F.lit("# "), F.col("c_name")),
                       F.concat(F.lit("Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
                       F.array_join(item_lines, "\n"),
                       F.concat(F.lit("Subtotal: $"), cents_text(F.col("line_cents"))),
                       F.concat(F.lit("Tax: $"), cents_text(total_cents % 10000)),
                       F.concat(F.lit("Total: $"), cents_text(total_cents)))
    return orders_with_lines(spark, sf_dir).select(
        file_name_of(k).alias("file_name"), "o_orderkey",
        F.concat(F.lit("/data/receipts/"), file_name_of(k)).alias("path"),
        text.alias("ocr_text"))
