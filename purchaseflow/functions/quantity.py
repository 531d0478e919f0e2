"""Quantity normalisation (FN5 lenient, FN6 strict)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import is_fractional_type, is_integer_type, is_number_type, is_whole_type, value_parts


def float_text(d: Column) -> Column:
    """Text of a float the way Python prints it: shortest digits, plain between 0.0001 and
    1e16 (``2.0``, ``12345678.5``, ``0.0001``), with a two-digit exponent outside
    (``1e-05``, ``1.5e+16``)."""
    size = F.abs(d)
    plain = F.regexp_replace(d.cast("string").try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    parts = F.split(d.cast("string"), "E")
    power = parts[1].cast("int")
    exponent = F.concat(F.regexp_replace(parts[0], r"\.0$", ""), F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return (F.when((d == F.floor(d)) & (size < F.lit(1e16)), F.format_string("%.1f", d))
            .when((size >= F.lit(1e-4)) & (size < F.lit(1e16)), plain).otherwise(exponent))


def int_text(d: Column) -> Column:
    """Text of a whole double as an integer (exact decimal expansion, no exponent)."""
    return F.format_string("%.0f", d)


def quantity_from_text(text: Column) -> Column:
    """FN5 on text: digits and dots only, read as a number; 1 when that fails."""
    return F.coalesce(
        F.nullif(F.regexp_replace(text, r"[^0-9.]", ""), F.lit("")).try_cast("double"),
        F.lit(1.0))


def number_in_text(p: Column) -> Column:
    """What :func:`quantity_from_text` reads in a value that is neither number nor boolean."""
    t = p["t"]
    return F.when(~is_number_type(t) & (t != "BOOLEAN"), quantity_from_text(F.when(t == "STRING", p["str"]).otherwise(p["json"])))


def normalize_quantity_parts(p: Column, from_text: Column | None = None) -> Column:
    """FN5 on a JSON value given as :func:`value_parts` ->
    ``struct(quantity DOUBLE, quantity_text STRING)``.  ``from_text``:
    :func:`number_in_text` of the value, where the caller holds it already.

    Missing -> 1.  JSON integers and floats are kept as they are (``2`` and ``2.0``
    stay apart in the text), booleans print as ``True``/``False``; any other value
    is stripped to digits and dots and read as a number (whole numbers become
    integers), 1 when nothing parses (JSON null included).
    """
    t = p["t"]
    num = p["num"]
    from_text = number_in_text(p) if from_text is None else from_text
    text_qty_text = F.when(from_text == F.floor(from_text), int_text(from_text)).otherwise(
        float_text(from_text))
    default = p["missing"] | p["jnull"]
    quantity = (F.when(default, F.lit(1.0))
                .when(is_integer_type(t) | is_fractional_type(t), num)
                .when(t == "BOOLEAN", F.when(p["bool"], F.lit(1.0)).otherwise(F.lit(0.0)))
                .otherwise(from_text))
    quantity_text = (F.when(default, F.lit("1"))
                     .when(is_whole_type(t), p["str"])
                     .when(is_fractional_type(t), float_text(num))
                     .when(t == "BOOLEAN", F.when(p["bool"], F.lit("True")).otherwise(F.lit("False")))
                     .otherwise(text_qty_text))
    return F.struct(quantity.alias("quantity"), quantity_text.alias("quantity_text"))


def normalize_quantity(v: Column) -> Column:
    """FN5 on a VARIANT value (SQL null when the key is missing)."""
    return normalize_quantity_parts(value_parts(v))


def strict_quantity(text: Column) -> Column:
    """FN6: whole-number text (surrounding blanks and a sign allowed) as BIGINT;
    null where the reference raises (``1.5``, ``2x``, blank)."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
