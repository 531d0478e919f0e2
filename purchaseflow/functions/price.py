"""Price cleaning (FN1 lenient, FN2 strict) as native column expressions.

Both run inside whole-stage codegen: no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import is_number_type, value_parts

# Price words that mean "no charge" (compared upper-cased, exact).
FREE_WORDS = ["FREE", "COMP", "COMPLIMENTARY", "GRATIS", "N/C", "NC", "NO CHARGE"]
# Fixed value: the literal text treated as "no price".
NA_TEXT = "N/A"

_NOT_NUMERIC = r"[^0-9.]"


def _digits_and_dots(text: Column) -> Column:
    return F.regexp_replace(text, _NOT_NUMERIC, "")


def price_from_text(text: Column) -> Column:
    """FN1 on a text value: blank, ``N/A`` and price words give 0.0; otherwise every
    character except digits and dots is dropped (so signs and thousands separators are
    lost) and the rest is read as a number, 0.0 when it is not one."""
    stripped = _digits_and_dots(text)
    value =F.coalesce(F.nullif(stripped, F.lit("")).try_cast("double"), F.lit(0.0))
    return (F.when(text.isNull() | (text == "") | (text == NA_TEXT), F.lit(0.0))
            .when(F.upper(text).isin(FREE_WORDS), F.lit(0.0))
            .otherwise(value))


def clean_price_parts(p: Column) -> Column:
    """FN1 on a JSON value given as :func:`value_parts`.

    Type is tested first: JSON numbers keep their sign, ``true`` is 1.0, falsy values
    (null, missing, 0, false, "", [], {}) are 0.0, strings go through
    :func:`price_from_text`, and nested values are read from their JSON text like any
    other text.
    """
    t = p["t"]
    return (F.when(p["missing"] | p["jnull"], F.lit(0.0))
            .when(is_number_type(t), F.coalesce(p["num"], F.lit(0.0)))
            .when(t == "BOOLEAN", F.when(p["bool"], F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(t == "STRING", price_from_text(p["str"]))
            .when(p["json"].isin("[]", "{}"), F.lit(0.0))
            .otherwise(price_from_text(p["json"])))


def clean_price(v: Column) -> Column:
    """FN1 on a VARIANT value (a JSON field; SQL null when the key is missing)."""
    return clean_price_parts(value_parts(v))


def strict_price(text: Column) -> Column:
    """FN2: strip to digits and dots and read a number; null where the reference
    raises (no digits left, or more than one dot)."""
    return F.nullif(_digits_and_dots(F.coalesce(text, F.lit("None"))), F.lit("")).try_cast("double")
