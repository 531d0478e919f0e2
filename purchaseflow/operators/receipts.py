"""Receipt validation: model response text -> typed receipt -> result row.

Covers SRC7 (parse), FN8 (default missing keys), FN9 (non-list items), REL6 (valid
items), FN10 (the composite), REL5/REL4 (projections), REL8 (explode), REL12
(failure routing) and FN13 (item text).  Everything is one narrow ``select`` chain
over VARIANT values: no UDF and no shuffle; the top level is code-generated, the passes
over the item array are not (higher-order functions are interpreted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_value, standardize_date
from ..functions.price import clean_price_parts
from ..functions.quantity import normalize_quantity_parts, number_in_text
from ..functions.text import items_text, line_total, strip_text
from ..functions.variants import (field, is_number_type, is_object, parts_text, parts_truthy, typed, value_text,
                                  views, with_views)

# Keys every receipt is completed with.
REQUIRED_KEYS = ["business_name", "business_address", "date", "items", "subtotal", "tax", "total"]
TOP_LEVEL = [k for k in REQUIRED_KEYS if k != "items"]


def _text_value(p: Column) -> Column:
    """Missing -> '' (default fill); JSON null -> null; otherwise its text.
    ``p`` is a :func:`views` struct."""
    return (F.when(p["missing"], F.lit(""))
            .when(p["jnull"], F.lit(None).cast("string"))
            .otherwise(parts_text(p)))


# An item's fields; the first is read as text, which is null for JSON null, or as it is.
ITEM_FIELDS = "array<struct<description:string,quantity:variant,price:variant>>"
ITEM_FIELDS_AS_IS = "array<struct<description:variant,quantity:variant,price:variant>>"


def _description(d: Column) -> Column:
    # JSON null prints as 'None' and is kept (quirk K9)
    return F.when(d["missing"], F.lit("")).when(d["jnull"], F.lit("None")).otherwise(strip_text(parts_text(d)))


def _text_parts(t: Column, text: Column, num: Column) -> dict[str, Column]:
    """What :func:`views` holds, from the type name, the text and the number of a value."""
    return {"missing": t.isNull(), "jnull": t == "VOID", "t": t, "num": num, "str": text, "json": text, "bool": text == "true"}


def _number(t: Column, text: Column) -> Column:
    """A quantity's number: of a number itself, else the one in its text."""
    num = text.try_cast("double")
    return F.when(is_number_type(t), num).otherwise(number_in_text(_text_parts(t, text, num)))


def _item(s: Column) -> Column:
    q = normalize_quantity_parts(_text_parts(s["q_t"], s["q_s"], s["n"]), s["n"])
    return F.struct(s["d"].alias("description"), q["quantity"].alias("quantity"),
                    q["quantity_text"].alias("quantity_text"), s["price"].alias("price"))


def valid_items(v: Column, compat: bool = False) -> Column:
    """FN9 + REL6 + FN5/FN7/FN1 per element: ``array<struct<description, quantity,
    quantity_text, price>>``; object elements with a non-blank description only.

    Passes over the array, each a cheap per-element step that reads what the one before
    has computed (nothing is shared inside a step): read every element as a struct of three
    variant fields, clean the descriptions, drop the blank ones, read the text of quantity
    and price, then the number and the price, derive the cleaned quantity.  A step hands on
    only what a later one reads: these passes are interpreted, and every field of theirs is
    paid for in each item.
    """
    texts = F.transform(described_items(v, compat), lambda s: F.struct(
        s["d"].alias("d"), s["q"]["t"].alias("q_t"), value_text(s["q"]).alias("q_s"),
        s["p"]["t"].alias("p_t"), value_text(s["p"]).alias("p_s")))
    read = F.transform(texts, lambda s: F.struct(
        s["d"].alias("d"), s["q_t"].alias("q_t"), s["q_s"].alias("q_s"), _number(s["q_t"], s["q_s"]).alias("n"),
        clean_price_parts(_text_parts(s["p_t"], s["p_s"], s["p_s"].try_cast("double"))).alias("price")))
    return F.transform(read, _item)


def described_items(v: Column, compat: bool = False, written: bool = True) -> Column:
    """FN9 + REL6 + FN7: the items with a non-blank description ``d``, with quantity ``q``
    and price ``p`` as :func:`typed` (as they are, unless ``written``)."""
    # Items that are no objects read as null: they have no description and go with the blank ones.
    read = F.try_variant_get(v, "$.items", ITEM_FIELDS_AS_IS if compat else ITEM_FIELDS)
    objects = F.coalesce(read, F.array().cast(ITEM_FIELDS_AS_IS if compat else ITEM_FIELDS))
    as_is = typed if written else (lambda c: c)
    if compat:
        objects = F.transform(objects, lambda s: F.struct(
            views(typed(s["description"])).alias("description"), s["quantity"].alias("quantity"), s["price"].alias("price")))
    described = F.transform(objects, lambda s: F.struct(
        (_description(s["description"]) if compat else strip_text(F.coalesce(s["description"], F.lit("")))).alias("d"),
        as_is(s["quantity"]).alias("q"), as_is(s["price"]).alias("p")))
    return F.filter(described, lambda s: s["d"] != "")


def validate_receipts(df: DataFrame, response: str = "response", compat: bool = False,
                      day_first: bool = False) -> DataFrame:
    """Add the validated receipt columns to ``df``.

    New columns: ``parse_status`` (``ok``; ``bad_json`` when the text is no JSON;
    ``failed`` when the top level is no object), ``business_name``, ``business_address``,
    ``date``, ``date_value`` (a DATE, null when the text is none), ``items``, ``subtotal``,
    ``tax``, ``total`` and ``extra_json`` (the other keys of the answer as one JSON object,
    null without any).  A date that is no text is read from its text; with ``compat`` the
    whole receipt is ``failed`` instead (quirk K12).
    """
    # Stage 1: parse once.  Later stages reference the parsed value and the extracted
    # fields as attributes, so Catalyst keeps them as separate projections instead of
    # re-parsing the text for every use.
    v = F.col("_v")
    parsed = df.withColumn("_v", F.try_parse_json(F.col(response)))
    # Stage 2: whether the top level is an object, and the variant fields.
    fields = parsed.select("*", is_object(v).alias("_object"),
                           F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"),
                                        lambda k, _: ~k.isin(REQUIRED_KEYS)).alias("_extra"),
                           *[field(v, k).alias(f"_f_{k}") for k in TOP_LEVEL])
    # Stage 3: each field's type, text and number as columns.  The cleaning expressions
    # test them in many branches; reading an attribute keeps the generated code
    # small (inlined, the test is repeated hundreds of times and whole-stage
    # code generation gives up on the stage).
    fields, seen = with_views(fields, [f"_f_{k}" for k in TOP_LEVEL])

    def parts(k: str) -> Column:
        return seen[f"_f_{k}"]
    date_p = parts("date")
    odd_date = ~date_p["missing"] & ~date_p["jnull"] & (date_p["t"] != "STRING") & parts_truthy(date_p)
    status = (F.when(v.isNull(), F.lit("bad_json"))
              .when(~F.col("_object"), F.lit("failed"))
              .when(odd_date & F.lit(compat), F.lit("failed"))
              .otherwise(F.lit("ok")))
    # Stage 4: status and the raw date text.
    staged = fields.withColumn("parse_status", status) \
        .withColumn("_date_raw", _text_value(date_p)).withColumn("_date_read", (date_p["t"] == "STRING") | odd_date)
    raw_date = F.col("_date_raw")
    staged = staged.withColumn("_date", F.when(F.col("_date_read"), standardize_date(raw_date, day_first)).otherwise(raw_date))
    date = F.col("_date")
    ok = F.col("parse_status") == "ok"
    empty_items = F.array().cast("array<struct<description:string,quantity:double,"
                                 "quantity_text:string,price:double>>")
    out = staged.select(
        *df.columns, "parse_status",
        F.when(ok, _text_value(parts("business_name"))).otherwise(F.lit("")).alias("business_name"),
        F.when(ok, _text_value(parts("business_address"))).otherwise(F.lit("")).alias("business_address"),
        F.when(ok, date).otherwise(F.lit("")).alias("date"),
        F.when(ok, date_value(date)).alias("date_value"),
        F.when(ok, valid_items(v, compat)).otherwise(empty_items).alias("items"),
        F.when(ok, clean_price_parts(parts("subtotal"))).otherwise(F.lit(0.0)).alias("subtotal"),
        F.when(ok, clean_price_parts(parts("tax"))).otherwise(F.lit(0.0)).alias("tax"),
        F.when(ok, clean_price_parts(parts("total"))).otherwise(F.lit(0.0)).alias("total"),
        F.when(ok & (F.size("_extra") > 0), F.to_json("_extra")).alias("extra_json"))
    return out


def is_receipt(response: Column) -> Column:
    """Whether a response is a JSON object (anything else makes no receipt)."""
    return is_object(F.try_parse_json(response))


def extracted_json(prefix: str = "") -> Column:
    """SNK6: JSON text of the validated receipt, nulls and the answer's other keys kept."""
    c = lambda n: F.col(prefix + n)
    items = F.transform(c("items"), lambda it: F.struct(
        it["description"].alias("description"), it["quantity"].alias("quantity"),
        it["price"].alias("price")))
    own = F.to_json(F.struct(
        c("business_name").alias("business_name"), c("business_address").alias("business_address"),
        c("date").alias("date"), items.alias("items"), c("subtotal").alias("subtotal"),
        c("tax").alias("tax"), c("total").alias("total")), {"ignoreNullFields": "false"})
    extra = c("extra_json")
    # Two objects become one: the first without its last brace, the second without its first.
    # Inside the lambda the first is a variable, so it is written once.
    return F.transform(F.array(own), lambda x: F.when(extra.isNull(), x).otherwise(F.concat(
        F.substring(x, F.lit(1), F.length(x) - 1), F.lit(","), F.substring(extra, F.lit(2), F.length(extra)))))[0]


def to_result_rows(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """REL4 + REL12: one row of the result schema per file.

    ``status`` decides the shape: ``ok`` -> validated values; ``bad_json`` -> blank
    record that keeps the raw OCR and its time; anything else -> placeholder row
    (blanks, zeros, ``{}``).  Expects ``file_name, status, raw_ocr, processing_time``
    plus the columns added by :func:`validate_receipts`; ``keep`` columns are carried.
    """
    s = F.col("status")
    ok = s == "ok"
    kept = s.isin("ok", "bad_json")
    return df.select(
        F.col("file_name").alias("File_Name"),
        F.when(ok, F.col("business_name")).otherwise(F.lit("")).alias("Business_Name"),
        F.when(ok, F.col("business_address")).otherwise(F.lit("")).alias("Business_Address"),
        F.when(ok, F.col("date")).otherwise(F.lit("")).alias("Date"),
        F.when(ok, items_text(F.col("items"), validated=True)).otherwise(F.lit("")).alias("Items"),
        F.when(ok, F.col("subtotal")).otherwise(F.lit(0.0)).alias("Subtotal"),
        F.when(ok, F.col("tax")).otherwise(F.lit(0.0)).alias("Tax"),
        F.when(ok, F.col("total")).otherwise(F.lit(0.0)).alias("Total"),
        F.when(kept, F.col("processing_time")).otherwise(F.lit(0.0)).alias("Processing_Time_Seconds"),
        F.when(kept, F.col("raw_ocr")).otherwise(F.lit("")).alias("Raw_OCR"),
        F.when(ok, extracted_json()).otherwise(F.lit("{}")).alias("Extracted_JSON"),
        *(keep or []),
    )


def resolve_status(df: DataFrame, attempt_status: str = "status") -> DataFrame:
    """Combine the extraction status with the parse status: an ``ok`` extraction
    whose response does not parse becomes ``bad_json`` (counted as done) or
    ``failed`` (placeholder)."""
    a = F.col(attempt_status)
    return df.withColumn(attempt_status, F.when(a == "ok", F.col("parse_status")).otherwise(a))


def explode_items(df: DataFrame, keys: list[str]) -> DataFrame:
    """REL8 + FN14: one row per item with its 1-based position and line total;
    receipts without items produce no rows.

    The output row is shaped inside the array and then ``inline``d: every field of
    the generated struct is used, so the optimizer has no nested field to prune
    through the generator (which would re-inline the whole validation below it).
    """
    rows = F.transform("items", lambda it, i: F.struct(
        (i + 1).alias("pos"), it["description"].alias("description"),
        it["quantity"].alias("quantity"), it["quantity_text"].alias("quantity_text"),
        it["price"].alias("price"), line_total(it["quantity"], it["price"]).alias("line_total")))
    return df.select(*keys, F.inline(rows))


def explode_response_items(df: DataFrame, keys: list[str], response: str = "response",
                           attempt_status: str = "status", compat: bool = False) -> DataFrame:
    """REL8 + FN14 straight from the answers: the same rows as :func:`explode_items` of the
    validated receipts.  Only the test for a blank description runs inside the array; the
    items are then rows, and quantities and prices are cleaned as plain, code-generated
    columns."""
    parsed = (df.filter(F.col(attempt_status) == "ok")
              .select(*keys, F.try_parse_json(F.col(response)).alias("_v")))
    rows = parsed.select(*keys, F.posexplode(described_items(F.col("_v"), compat, written=False)).alias("_pos", "_s"))
    fields = rows.select(*keys, "_pos", F.col("_s.d").alias("_d"), F.col("_s.q").alias("_q"), F.col("_s.p").alias("_p"))
    staged, seen = with_views(fields, ["_q", "_p"])
    staged = staged.withColumn("_number", number_in_text(seen["_q"]))
    q = normalize_quantity_parts(seen["_q"], F.col("_number"))
    items = staged.select(*keys, (F.col("_pos") + 1).alias("pos"), F.col("_d").alias("description"),
                          q["quantity"].alias("quantity"), q["quantity_text"].alias("quantity_text"),
                          clean_price_parts(seen["_p"]).alias("price"))
    return items.withColumn("line_total", line_total(F.col("quantity"), F.col("price")))


def sum_item_prices(items: Column) -> Column:
    """AGG1 nested form: sum of unit prices (quantity ignored), 0 when empty."""
    return F.aggregate(items, F.lit(0.0), lambda acc, it: acc + it["price"])
