"""Labelled-cell responses: parse (SRC8), label dispatch (REL9), cell pivot (REL10),
complete-cell filter (REL7) and the price subtotal (AGG1).

A document is one row, and everything here stays inside it: the header reads a handful of
fields, and the pivot sorts a table's cells by (row, label, position), cuts the sorted
array where the row changes, and reads each piece once.  No row is shuffled, documents
never mix (whatever their names), and the work is that of one sort of a table's cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.price import strict_price
from ..functions.quantity import strict_quantity
from ..schemas import LABELLED

# Header labels and the table label of the labelled-cell response.
MERCHANT, DATE, TAX, TOTAL, TABLE = "Merchant_Name", "Date", "Tax_Amount", "Total_Amount", "table"
DESCRIPTION, PRICE, QUANTITY = "Description", "Price", "Quantity"


def parse_labelled(body: Column) -> Column:
    """SRC8: ``result[0].prediction`` of the response body (null when absent or malformed)."""
    parsed = F.from_json(body, LABELLED)
    return F.try_element_at(parsed["result"], F.lit(1))["prediction"]


def _last_text(pred: Column, label: str) -> Column:
    return F.try_element_at(F.filter(pred, lambda x: x["label"] == label), F.lit(-1))["ocr_text"]


def dispatch_labels(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """REL9: header values by label, last occurrence wins; tax and total through the
    strict price reader (null where the reference raises)."""
    p = F.col(prediction)
    return df.select(
        "*",
        _last_text(p, MERCHANT).alias("business_name"),
        _last_text(p, DATE).alias("date"),
        strict_price(_last_text(p, TAX)).alias("tax"),
        strict_price(_last_text(p, TOTAL)).alias("total"),
    )


# What an item needs of its row, in sorting order: the first price, the first quantity,
# then every description.
_KINDS = (PRICE, QUANTITY, DESCRIPTION)


def _row_items(group: Column) -> Column:
    """The items of one table row: ``group`` is its cells, sorted; each description is an
    item with the row's first price and first quantity."""
    def first(kind: int) -> Column:
        return F.try_element_at(F.filter(group, lambda c: c["kind"] == kind), F.lit(1))["text"]

    # Looked up once a row, however many descriptions it has.
    heads = F.struct(first(0).alias("price_text"), first(1).alias("quantity_text"))
    return _with(heads, lambda h: F.transform(F.filter(group, lambda c: c["kind"] == 2), lambda d: F.struct(
        d["row"].alias("row"), d["pos"].alias("desc_pos"), d["text"].alias("description"),
        h["price_text"].alias("price_text"), h["quantity_text"].alias("quantity_text"))))


def _table_items(cells: Column) -> Column:
    """REL10 on one table's cells -> its items by row and position."""
    kind = lambda c: F.array_position(F.array(*map(F.lit, _KINDS)), c["label"]) - 1
    useful = F.filter(F.transform(cells, lambda c, i: F.struct(
        c["row"].alias("row"), kind(c).cast("int").alias("kind"), i.alias("pos"), c["text"].alias("text"))),
        lambda c: c["kind"] >= 0)

    def grouped(s: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(s))
        starts = F.filter(places, lambda i: (i == 1) | ~s[i - 2]["row"].eqNullSafe(s[i - 1]["row"]))
        return F.flatten(_with(starts, lambda at: F.transform(at, lambda a, n: _row_items(
            F.slice(s, a, F.coalesce(F.get(at, n + 1), F.size(s) + 1) - a)))))

    return F.when(F.size(useful) > 0, _with(F.array_sort(useful), grouped))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def table_items(prediction: Column) -> Column:
    """REL10 + REL7 + FN2/FN6: the complete items of every table field of a prediction,
    ``array<struct<field_pos, desc_pos, row, description, price_text, quantity_text, price,
    quantity>>`` in the order of their description cells.  Items without a description,
    price or quantity text are dropped."""
    nonblank = lambda c: F.coalesce(c != "", F.lit(False))
    tables = F.filter(F.transform(prediction, lambda f, i: F.struct(i.alias("pos"), f["label"].alias("label"), f["cells"].alias("cells"))),
                      lambda f: f["label"] == TABLE)
    items = F.flatten(F.filter(F.transform(tables, lambda t: F.transform(
        _table_items(t["cells"]), lambda it: F.struct(t["pos"].alias("field_pos"), it.alias("it")))),
        lambda x: x.isNotNull()))
    complete = F.filter(items, lambda x: nonblank(x["it"]["description"]) & nonblank(x["it"]["price_text"])
                        & nonblank(x["it"]["quantity_text"]))
    return F.array_sort(F.transform(complete, lambda x: F.struct(
        x["field_pos"].alias("field_pos"), x["it"]["desc_pos"].alias("desc_pos"), x["it"]["row"].alias("row"),
        x["it"]["description"].alias("description"), x["it"]["price_text"].alias("price_text"),
        x["it"]["quantity_text"].alias("quantity_text"), strict_price(x["it"]["price_text"]).alias("price"),
        strict_quantity(x["it"]["quantity_text"]).alias("quantity"))))


def labelled_items(df: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """One row per complete item of every document: ``keys`` and the fields of
    :func:`table_items`."""
    return df.select(*keys, F.inline(table_items(F.col(prediction))))


def labelled_receipts(df: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    """REL9 + REL10 + REL7 + AGG1: per document its header values (last label wins), the
    sum of its item prices and its item count (0 without a table or cells).
    Output: ``keys, business_name, date, tax, total, subtotal, n_items``."""
    prices = F.transform(table_items(F.col(prediction)), lambda it: F.coalesce(it["price"], F.lit(0.0)))
    head = dispatch_labels(df.withColumn("_prices", prices), prediction)
    return head.select(*keys, "business_name", "date", "tax", "total",
                       F.coalesce(F.aggregate("_prices", F.lit(0.0), lambda acc, p: acc + p), F.lit(0.0)).alias("subtotal"),
                       F.coalesce(F.size("_prices"), F.lit(0)).cast("long").alias("n_items"))
