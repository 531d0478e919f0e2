"""Small helpers over VARIANT values produced by ``try_parse_json``.

Cleaning functions take a *parts* struct (:func:`value_parts`) rather than the raw
variant: type name, number, text and boolean views are extracted once, and every
later test reads a struct field.  Inside higher-order functions (which are not
code-generated) this keeps each element to one extraction per view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER_TYPES = ["BIGINT", "INT", "SMALLINT", "TINYINT"]


def vtype(v: Column) -> Column:
    """Type name of a variant value (``BIGINT``, ``DECIMAL(3,2)``, ``STRING``, ``OBJECT<...>``, ``VOID``)."""
    return F.schema_of_variant(v)


def is_integer_type(t: Column) -> Column:
    return t.isin(INTEGER_TYPES)


def is_whole_type(t: Column) -> Column:
    """Integers, also those too wide for a long, which are kept as decimals of 19 digits or
    more without a fraction (narrower ones are floats such as ``2.0``)."""
    return is_integer_type(t) | t.rlike(r"^DECIMAL\((19|[23]\d),0\)$")


def is_fractional_type(t: Column) -> Column:
    return t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT")


def is_number_type(t: Column) -> Column:
    return is_integer_type(t) | is_fractional_type(t)


def is_object(v: Column) -> Column:
    """Whether a variant is a JSON object (null: no), without writing out its whole type."""
    return F.try_variant_get(v, "$", "struct<date:variant>").isNotNull()


def field(v: Column, key: str) -> Column:
    """Variant field by key; SQL null when the key is missing (or ``v`` is not an
    object), a variant null when the JSON value is ``null``."""
    return F.try_variant_get(v, f"$.{key}", "variant")


def with_parsed(df, source: str, name: str = "_v"):
    """``df`` plus ``name`` = ``try_parse_json(source)`` as its own projection.

    Cleaning expressions read the variant in many conditional branches; referencing
    a staged column (rather than the parse expression itself) lets Catalyst keep the
    parse in a separate projection, so each text is parsed once.
    """
    return df.withColumn(name, F.try_parse_json(F.col(source)))


def typed(v: Column) -> Column:
    """``struct(v, t)``: a variant with its type name, computed once."""
    return F.struct(v.alias("v"), vtype(v).alias("t"))


def _text(v: Column, t: Column) -> Column:
    """The text of a string or a number.  A number is written as JSON: reading it as a string
    builds a cast for every value."""
    return F.when(t == "STRING", F.try_variant_get(v, "$", "string")).when(is_number_type(t), F.to_json(v))


def _views(v: Column, t: Column, text: Column, num: Column) -> Column:
    other = F.when(t.isin("STRING", "VOID") | is_number_type(t), F.lit(None)).when(t.isNotNull(), F.to_json(v))
    return F.struct(
        v.isNull().alias("missing"),
        F.coalesce(t == "VOID", F.lit(False)).alias("jnull"),
        t.alias("t"), num.alias("num"), text.alias("str"),
        F.when(t == "BOOLEAN", other == "true").alias("bool"),
        other.alias("json"))


def views(tv: Column) -> Column:
    """``struct(missing, jnull, t, num, str, bool, json)`` from a :func:`typed` struct.

    ``missing``: SQL null (key absent); ``jnull``: JSON null; ``t``: type name;
    ``num``: the number; ``str``: the text of a string or a number; ``bool``: the
    boolean; ``json``: JSON text of a nested value or a boolean.  Each view is read
    only for the types that need it.
    """
    v, t = tv["v"], tv["t"]
    # Numbers are read through their text and a native string->double cast: a direct
    # variant->double read costs far more per value (measured ~10x on decimals).
    return _views(v, t, _text(v, t), F.when(t == "STRING", F.lit(None)).when(is_number_type(t), F.to_json(v).try_cast("double")))


def with_views(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` plus helper columns, and the :func:`views` of its variant columns ``names``.
    Type, text and number are columns of their own, so the many branches that read them do
    not repeat them."""
    out = df.select("*", *[vtype(F.col(n)).alias(f"{n}_t") for n in names])
    out = out.select("*", *[_text(F.col(n), F.col(f"{n}_t")).alias(f"{n}_s") for n in names])
    out = out.select("*", *[F.when(is_number_type(F.col(f"{n}_t")), F.col(f"{n}_s").try_cast("double")).alias(f"{n}_n")
                            for n in names])
    return out, {n: _views(F.col(n), *[F.col(f"{n}_{x}") for x in "tsn"]) for n in names}


def value_parts(v: Column) -> Column:
    """:func:`views` of a variant (for column-level use, where Spark's common
    subexpression elimination shares the repeated reads)."""
    return views(typed(v))


def value_text(tv: Column) -> Column:
    """:func:`parts_text` straight from a :func:`typed` struct."""
    return F.when(tv["t"] == "STRING", F.try_variant_get(tv["v"], "$", "string")).when(tv["t"] != "VOID", F.to_json(tv["v"]))


def parts_text(p: Column) -> Column:
    """Text of a value: the string itself, a number's text, else the JSON text."""
    return F.coalesce(p["str"], p["json"])


def parts_truthy(p: Column) -> Column:
    """Python truthiness of a JSON value (null/missing, 0, false, "", [], {} are falsy)."""
    t = p["t"]
    return (F.when(p["missing"] | p["jnull"], F.lit(False))
            .when(is_number_type(t), F.coalesce(p["num"] != 0, F.lit(True)))
            .when(t == "BOOLEAN", p["bool"])
            .when(t == "STRING", p["str"] != "")
            .otherwise(~p["json"].isin("[]", "{}")))
