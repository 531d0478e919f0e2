"""T0: golden vectors for the scalar functions (FIXTURES.md section 3)."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from purchaseflow.functions.dates import standardize_date
from purchaseflow.functions.media import data_url, mime_type, size_plan
from purchaseflow.functions.price import clean_price, strict_price
from purchaseflow.functions.quantity import normalize_quantity, strict_quantity
from purchaseflow.functions.text import (base_name, display_date, display_name, items_text,
                                         money_or_na, money_or_zero, strip_text, uri_base_name)
from purchaseflow.functions.variants import field


def one_col(spark, values, fn, ddl="s string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(fn(F.col(df.columns[0]))).collect()]


def json_field(spark, raw_values, fn, key="x"):
    """Apply ``fn`` to the variant field ``key`` of ``{"x": <raw>}`` documents;
    ``None`` in ``raw_values`` means the key is missing."""
    docs = ["{}" if r is None else '{"%s": %s}' % (key, r) for r in raw_values]
    return one_col(spark, docs, lambda c: fn(field(F.try_parse_json(c), key)))


def test_clean_price_vectors(spark):
    raw = [None, "null", '""', "0", '"N/A"', "-5.25", '"-5.25"', "true", '"free"', '"No Charge"',
           '"n/c"', '"$1,234.56"', '"1.234,56"', '"(5.00)"', '"1e3"', '"5."', '"."', '"..5"',
           '"12.34.56"', '"abc"', "[]", "{}", "false"]
    want = [0.0, 0.0, 0.0, 0.0, 0.0, -5.25, 5.25, 1.0, 0.0, 0.0, 0.0, 1234.56, 1.23456, 5.0, 13.0,
            5.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert json_field(spark, raw, clean_price) == want


def test_strict_price_vectors(spark):
    got = one_col(spark, ["$3.50", "", "abc", "1.2.3", None], strict_price)
    assert got == [3.5, None, None, None, None]


def test_date_vectors(spark):
    cases = {
        "2023-1-5": "05-01-2023", "1/5/2023": "05-01-2023", "31/01/2023": "31-01-2023",
        "05-04-2023": "04-05-2023", "05.04.2023": "05-04-2023", "01.31.2023": "31-01-2023",
        "31 january 2023": "31-01-2023", "January  31,  2023": "31-01-2023",
        "1/5/68": "05-01-2068", "1/5/69": "05-01-1969",
        "01/31/2023 14:22": "01-31-2023", "2023-01-31T10:00": "31-01-2023",
        "01-31-23": "01-31-2023", "31-01-23": "01-31-2023", "05-04-51": "04-05-1951",
        "05-04-50": "04-05-2050", "2/30/2023": "02-30-2023", "Jan 31, 2023": "Jan 31, 2023",
        "yesterday": "yesterday", "": "", "012/05/2023": "012-05-2023",
    }
    got = one_col(spark, list(cases), standardize_date)
    assert dict(zip(cases, got)) == cases


def test_quantity_vectors(spark):
    raw = [None, "2", "2.0", '"2.0"', '"0.5 kg"', '"3x"', "null", '""', '"abc"', "-2", '"-2"', "0",
           "true"]
    got = json_field(spark, raw, normalize_quantity)
    assert [(r["quantity"], r["quantity_text"]) for r in got] == [
        (1.0, "1"), (2.0, "2"), (2.0, "2.0"), (2.0, "2"), (0.5, "0.5"), (3.0, "3"), (1.0, "1"),
        (1.0, "1"), (1.0, "1"), (-2.0, "-2"), (2.0, "2"), (0.0, "0"), (1.0, "True")]


def test_quantity_text_is_what_python_prints(spark):
    raw = ["12345678.5", "0.0001", "0.00012", "0.00001", "1e16", "2.5e17", "123456789012345.25", "-0.5", "1e3",
           "9007199254740993", "-9007199254740993", "12345678901234567890"]
    got = [r["quantity_text"] for r in json_field(spark, raw, normalize_quantity)]
    assert got == [str(json.loads(x)) for x in raw]
    text = json_field(spark, ['"12345678.5 kg"', '"0.0001"', '"x 90071992547409.5"', '"12345678"'], normalize_quantity)
    assert [r["quantity_text"] for r in text] == ["12345678.5", "0.0001", "90071992547409.5", "12345678"]


def test_strict_quantity_vectors(spark):
    assert one_col(spark, [" 2 ", "+2", "1.5", "2x", ""], strict_quantity) == [2, 2, None, None, None]


def test_strip_and_names(spark):
    assert one_col(spark, ["\t a \n", "  ", "b"], strip_text) == ["a", "", "b"]
    assert one_col(spark, ["/x/y/a.jpg", "http://h/p/q?x=1", "dir/"], base_name) == [
        "a.jpg", "q?x=1", ""]
    assert one_col(spark, ["file:/tmp/a%20b+c.jpg"], uri_base_name) == ["a b+c.jpg"]


def test_items_text(spark):
    df = spark.createDataFrame(
        [([("a", 2.0, "2", 3.0), ("b", 0.5, "0.5", 1.25), ("", 1.0, "1", 9.0)],), ([],)],
        "items array<struct<description:string,quantity:double,quantity_text:string,price:double>>")
    got = [r[0] for r in df.select(items_text(F.col("items"))).collect()]
    assert got == ["2x a ($3.00); 0.5x b ($1.25)", ""]


def test_display_and_money(spark):
    assert one_col(spark, [None, "", "Shop"], display_name) == ["Unknown Business", "Unknown Business", "Shop"]
    assert one_col(spark, [None, "", "1-1-2020"], display_date) == ["Unknown", "Unknown", "1-1-2020"]
    assert one_col(spark, [None, 0.0, 2.5], money_or_zero, "x double") == ["$0.00", "$0.00", "$2.50"]
    assert one_col(spark, [None, 0.0, 2.5], money_or_na, "x double") == ["N/A", "N/A", "$2.50"]


def test_size_plan(spark):
    df = spark.createDataFrame([(12 * 1048576, 4000, 3000), (3 * 1048576, 4000, 3000)],
                               "length bigint, w bigint, h bigint")
    got = df.select(size_plan(F.col("length"), F.col("w"), F.col("h")).alias("p")).collect()
    assert [(r.p.scale, r.p.new_width, r.p.new_height) for r in got] == [(0.5, 2000, 1500), (1.0, 4000, 3000)]


def test_data_url_one_line(spark):
    df = spark.createDataFrame([("x" * 300, "a.png")], "t string, n string")
    url = df.select(data_url(F.encode("t", "UTF-8"), mime_type(F.col("n")))).first()[0]
    assert url.startswith("data:image/png;base64,") and "\n" not in url


@pytest.mark.parametrize("doc,status", [
    ('{"a": 1', "bad_json"), ("[]", "failed"), ('"text"', "failed"),
    ('{"date": 0}', "ok"), ("{}", "ok")])
def test_parse_status(spark, doc, status):
    from purchaseflow.operators.receipts import validate_receipts
    df = spark.createDataFrame([(doc,)], "response string")
    assert validate_receipts(df).first()["parse_status"] == status


def test_a_date_that_is_no_text(spark):
    from purchaseflow.operators.receipts import validate_receipts
    df = spark.createDataFrame([('{"date": 20230101}',), ('{"date": ["2023-01-02"]}',), ('{"date": "2023-01-02"}',)], "response string")
    rows = validate_receipts(df).collect()
    assert [r.parse_status for r in rows] == ["ok", "ok", "ok"]
    assert (rows[0].date, rows[0].date_value) == ("20230101", None)
    assert (rows[2].date, str(rows[2].date_value)) == ("02-01-2023", "2023-01-02")
    assert [r.parse_status for r in validate_receipts(df, compat=True).collect()] == ["failed", "failed", "ok"]


def test_both_explodes_agree(spark, sf_small):
    from purchaseflow.operators.receipts import explode_items, explode_response_items, resolve_status, validate_receipts
    from purchaseflow.plans import fixtures as fx
    odd = spark.createDataFrame([("x.jpg", '{"items": [{"description": null, "price": 2}, 3, {"description": " a "}]}', "ok"),
                                 ("y.jpg", '{"items": [{"description": "b"}]}', "failed")], "file_name string, response string, status string")
    for compat in (False, True):
        for df in (odd, fx.f1_receipts(spark, sf_small)):
            one = explode_items(resolve_status(validate_receipts(df, compat=compat)).filter("status = 'ok'"), ["file_name"])
            two = explode_response_items(df, ["file_name"], compat=compat)
            assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_the_prompts_are_the_fixed_texts():
    from hashlib import sha256

    from purchaseflow.functions import text
    got = {n: sha256(getattr(text, n).encode()).hexdigest()[:16] for n in dir(text) if n.startswith("PROMPT_")}
    assert got == {"PROMPT_HEAD": "18ecf359c8340d17", "PROMPT_TAIL_BATCH": "6d003b38317704cf", "PROMPT_TAIL_SINGLE": "8222167e836e749d"}


def test_other_keys_stay_in_the_json(spark):
    from purchaseflow.operators.receipts import extracted_json, validate_receipts
    docs = ['{"currency": "USD", "total": "$2", "more": {"a": [1, null]}, "none": null}', '{"total": 1}', "{}"]
    got = [json.loads(r[0]) for r in validate_receipts(spark.createDataFrame([(d,) for d in docs], "response string"))
           .select(extracted_json()).collect()]
    blank = {"business_name": "", "business_address": "", "date": "", "items": [], "subtotal": 0.0, "tax": 0.0, "total": 0.0}
    assert got == [{**blank, "total": 2.0, "currency": "USD", "more": {"a": [1, None]}, "none": None}, {**blank, "total": 1.0}, blank]


def test_validate_defaults_and_items(spark):
    from purchaseflow.operators.receipts import validate_receipts
    doc = {"business_name": None, "items": [{"description": " x ", "quantity": "2", "price": "$1.50"},
                                            {"description": None}, "junk", {"price": 3}],
           "subtotal": "N/A", "extra": 1}
    r = validate_receipts(spark.createDataFrame([(json.dumps(doc),)], "response string")).first()
    assert r["business_name"] is None and r["business_address"] == "" and r["date"] == ""
    assert [(i.description, i.quantity_text, i.price) for i in r["items"]] == [("x", "2", 1.5)]
    assert (r["subtotal"], r["tax"], r["total"]) == (0.0, 0.0, 0.0)
    compat = validate_receipts(spark.createDataFrame([(json.dumps(doc),)], "response string"),
                               compat=True).first()
    assert [i.description for i in compat["items"]] == ["x", "None"]
    items = validate_receipts(spark.createDataFrame([('{"items": {"a": 1}}',)], "response string")).first()
    assert items["items"] == []


def test_day_first_option(spark):
    from purchaseflow.functions.dates import standardize_date
    got = one_col(spark, ["05-04-2023", "31-01-2023", "04/05/2023"],
                  lambda c: standardize_date(c, day_first=True))
    # only the dash formats swap order; the slash formats stay month-first
    assert got == ["05-04-2023", "31-01-2023", "05-04-2023"]


def test_date_whitespace_and_json_null(spark):
    from purchaseflow.operators.receipts import validate_receipts
    docs = ['{"date": null}', '{"date": "  "}', '{"date": "March\\t5,\\n2024"}', "{}"]
    got = [r["date"] for r in validate_receipts(
        spark.createDataFrame([(d,) for d in docs], "response string")).collect()]
    assert got == [None, "  ", "05-03-2024", ""]


def test_price_words_and_nested_values(spark):
    raw = ['"comp"', '"GRATIS"', '"NC"', '[1, 2]', '{"a": 7}', '"  12.50 "']
    assert json_field(spark, raw, clean_price) == [0.0, 0.0, 0.0, 12.0, 7.0, 12.5]
