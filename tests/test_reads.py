"""What the receipt queries read from a value, how often, and with which result."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from purchaseflow.operators.extract import answer_of_text
from purchaseflow.operators.receipts import explode_response_items, sum_item_prices, validate_receipts

ITEMS = r'''[{"description": "\ta \"b\" ", "quantity": 2.0, "price": "$1,000.50"}, "see reverse", null, [1],
 {"description": 7, "quantity": 2, "price": 100.0}, {"description": true, "quantity": "2.50 kg", "price": true},
 {"description": "é ", "quantity": 12345678901234567890, "price": -3}, {"description": null, "price": 1},
 {"description": {"a": 1}, "quantity": null, "price": {"b": 2}}, {"description": " "}, {"quantity": 1},
 {"description": "x", "quantity": 1e-5, "price": null}, {"description": "y", "quantity": true, "price": "comp"}]'''
WANT = [('a "b"', 2.0, "2.0", 1000.5), ("7", 2.0, "2", 100.0), ("true", 2.5, "2.5", 1.0),
        ("é", 12345678901234567890.0, "12345678901234567890", -3.0), ('{"a":1}', 1.0, "1", 2.0),
        ("x", 1e-05, "1e-05", 0.0), ("y", 1.0, "True", 0.0)]


def answers(spark):
    return spark.createDataFrame([("a", '{"items": %s}' % ITEMS, "ok"), ("b", "[]", "ok"), ("c", "{", "ok"), ("d", None, "ok"),
                                  ("e", '{"items": {"description": "no list"}}', "ok")], "file_name string, response string, status string")


def test_items_of_all_kinds_of_values(spark):
    rows = explode_response_items(answers(spark), ["file_name"]).orderBy("pos").collect()
    assert [(r.description, r.quantity, r.quantity_text, r.price) for r in rows] == WANT
    assert [(r.file_name, r.pos) for r in rows] == [("a", i + 1) for i in range(len(WANT))]
    valid = validate_receipts(answers(spark)).select("*", sum_item_prices(F.col("items")).alias("total_price"))
    by_name = {r.file_name: r for r in valid.collect()}
    assert [(i.description, i.quantity, i.quantity_text, i.price) for i in by_name["a"]["items"]] == WANT
    assert {n: r.parse_status for n, r in by_name.items()} == {"a": "ok", "b": "failed", "c": "bad_json", "d": "bad_json", "e": "ok"}
    assert by_name["a"].total_price == sum(w[3] for w in WANT) and by_name["e"]["items"] == []
    compat = validate_receipts(answers(spark), compat=True).filter("file_name = 'a'").first()
    assert [i.description for i in compat["items"]] == [*[w[0] for w in WANT[:4]], "None", *[w[0] for w in WANT[4:]]]


def test_a_value_is_read_once_not_once_per_branch(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    plan = explode_response_items(answers(spark), ["file_name"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") < 15 and plan.count("regexp_replace(") < 15


def test_methods_that_the_jvm_never_compiles_are_not_used(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_item_lines_are_cut_as_the_pattern_says(spark):
    lines = ["# shop", "12 x a x b 3 $1.50", "1 x  c  $2.00\r", "3 x $4.00", "x 2 x d $1.00", "4 x e $1.000", "5 x é ü $10.99", "6 x f $1.00 "]
    found = spark.createDataFrame([("\n".join(lines),)], "t string").select(answer_of_text(F.col("t")).alias("a")).first().a
    assert [(i["quantity"], i["description"], i["price"]) for i in json.loads(found)["items"]] == [
        (12, "a x b 3", "$1.50"), (1, " c ", "$2.00"), (5, "é ü", "$10.99")]
