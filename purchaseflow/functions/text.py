"""Text helpers: description strip, base name, item text, money text, display
defaults and the extraction prompt (FN7, FN11, FN13-FN17)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display defaults for a missing business name / date.
UNKNOWN_BUSINESS = "Unknown Business"
UNKNOWN_DATE = "Unknown"
NOT_AVAILABLE = "N/A"

# The extraction instruction wrapped around the OCR text (batch form,
# seven fields) and the shorter single-image form (six fields).
PROMPT_HEAD = "This is image's OCR in markdown:\n\n"
PROMPT_TAIL_BATCH = (
    "\n.\n"
    "Extract the following information from this receipt in JSON format:\n"
    "1. business_name: The name of the business or restaurant\n"
    "2. business_address: The full address of the business\n"
    "3. date: The receipt date in format DD-MM-YYYY\n"
    "4. items: Array of purchased items, each with description, quantity, and price\n"
    "5. subtotal: The subtotal amount before tax\n"
    "6. tax: The tax amount\n"
    "7. total: The total amount paid\n\n"
    "Return only valid JSON with these fields. For items, always include 'description', "
    "'quantity', and 'price' fields."
)
PROMPT_TAIL_SINGLE = (
    "\n.\n"
    "Extract the following information from this receipt in JSON format: "
    "business_name, date, items (array of objects with description, quantity, price), "
    "subtotal, tax, and total. "
    "The output should be strictly be json with no extra commentary."
)


# The characters Python's str.strip() removes by default (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def strip_text(s: Column) -> Column:
    """FN7: remove leading/trailing whitespace as Python's ``str.strip()`` does
    (Spark ``trim`` strips spaces only).  A text with visible ASCII at both ends has
    nothing to strip and is not searched."""
    visible = [F.substring(s, i, 1).between("!", "~") for i in (1, -1)]
    return F.when(visible[0] & visible[1], s).otherwise(F.btrim(s, F.lit(PY_WHITESPACE)))


def base_name(path: Column) -> Column:
    """FN11: last path segment (everything after the last ``/``; blank for a trailing ``/``)."""
    return F.regexp_extract(path, r"[^/]*$", 0)


def uri_base_name(uri: Column) -> Column:
    """FN11 for Spark file-source paths, which are percent-encoded URIs.  ``+`` is
    protected first because ``url_decode`` would turn it into a space."""
    return F.url_decode(F.replace(base_name(uri), F.lit("+"), F.lit("%2B")))


def money(x: Column) -> Column:
    """``$`` and two decimals (no thousands separator)."""
    return F.concat(F.lit("$"), F.format_string("%.2f", x))


def money_or_zero(x: Column) -> Column:
    """FN15, single-image LLM form: falsy amount shows as ``$0.00``."""
    return money(F.when(x.isNull() | (x == 0), F.lit(0.0)).otherwise(x))


def money_or_na(x: Column) -> Column:
    """FN15, labelled-cell form: falsy tax/total shows as ``N/A``."""
    return F.when(x.isNull() | (x == 0), F.lit(NOT_AVAILABLE)).otherwise(money(x))


def display_name(name: Column) -> Column:
    """FN16: null or blank business name -> ``Unknown Business``."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(UNKNOWN_BUSINESS))


def display_date(date: Column) -> Column:
    """FN16: null or blank date -> ``Unknown``."""
    return F.coalesce(F.nullif(date, F.lit("")), F.lit(UNKNOWN_DATE))


def item_text(item: Column) -> Column:
    """One item as ``{qty}x {description} (${price:.2f})``."""
    return F.concat(item["quantity_text"], F.lit("x "), item["description"], F.lit(" ("),
                    money(item["price"]), F.lit(")"))


def items_text(items: Column, validated: bool = False) -> Column:
    """FN13: items joined with ``"; "``; items without a description are skipped,
    blank when nothing is left.  ``validated=True`` skips that filter for arrays that
    already hold only described items (the output of receipt validation)."""
    kept = items if validated else F.filter(
        items, lambda x: F.coalesce(x["description"], F.lit("")) != "")
    return F.coalesce(F.array_join(F.transform(kept, item_text), "; "), F.lit(""))


def render_prompt(raw_ocr: Column, batch: bool = True) -> Column:
    """FN17: the instruction sent with the OCR text."""
    tail = PROMPT_TAIL_BATCH if batch else PROMPT_TAIL_SINGLE
    return F.concat(F.lit(PROMPT_HEAD), F.coalesce(raw_ocr, F.lit("")), F.lit(tail))


def line_total(quantity: Column, price: Column) -> Column:
    """FN14: quantity times unit price."""
    return quantity * price
