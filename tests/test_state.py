"""T3: metamorphic invariants of the state and metric operators."""

from __future__ import annotations

import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from purchaseflow.operators.labelled import (dispatch_labels, labelled_items, labelled_receipts,
                                             parse_labelled)
from purchaseflow.operators.metrics import running_counts
from purchaseflow.operators.state import (latest_attempts, pending_files, split_results, state_of,
                                          union_rows)
from purchaseflow import session
from purchaseflow.plans import fixtures as fx


def test_upsert_is_idempotent(spark, sf_small):
    att = fx.f6_attempts(spark, sf_small)
    once = latest_attempts(att)
    twice = latest_attempts(union_rows(att, att))
    cols = ["file_name", "attempt_seq", "status", "first_seen"]
    assert sorted(once.select(cols).collect()) == sorted(twice.select(cols).collect())


def test_upsert_latest_wins_over_union(spark):
    old = spark.createDataFrame([("a.jpg", 1, "failed"), ("b.jpg", 2, "ok")],
                                "file_name string, attempt_seq bigint, status string")
    new = spark.createDataFrame([("a.jpg", 3, "ok")], "file_name string, attempt_seq bigint, status string")
    got = {r.file_name: (r.attempt_seq, r.status, r.first_seen, r.n_attempts)
           for r in latest_attempts(union_rows(old, new), order=["attempt_seq"]).collect()}
    assert got == {"a.jpg": (3, "ok", 1, 2), "b.jpg": (2, "ok", 2, 1)}


def test_a_later_run_wins_whatever_its_numbers(spark):
    rows = [("a.jpg", 1, 900, "failed"), ("a.jpg", 2, 0, "ok"), ("a.jpg", 1, 5, "failed"), ("b.jpg", 1, 3, "ok"), ("b.jpg", 1, 3, "ok")]
    log = spark.createDataFrame(rows, "file_name string, run_seq long, attempt_seq long, status string")
    got = {r.file_name: (r.run_seq, r.attempt_seq, r.status, r.first_seen, r.n_attempts) for r in latest_attempts(log).collect()}
    assert got == {"a.jpg": (2, 0, "ok", 5, 3), "b.jpg": (1, 3, "ok", 3, 2)}
    assert latest_attempts(log).count() == 2


def test_split_is_a_partition_and_pending_disjoint(spark, sf_small):
    latest = state_of(latest_attempts(fx.f6_attempts(spark, sf_small)))
    n = latest.count()
    completed = latest.filter("state = 'completed'").count()
    placeholder = latest.filter("state = 'placeholder'").count()
    assert completed + placeholder == n
    files = fx.customer_files(spark, sf_small)
    pending = pending_files(files, latest)
    done = latest.filter("state = 'completed'").select("file_name")
    assert pending.join(done, "file_name").count() == 0
    assert pending.count() + done.join(files, "file_name", "left_semi").count() == files.count()


def test_split_results_csv_interop(spark):
    rows = spark.createDataFrame(
        [("a.jpg", "Shop"), ("b.jpg", ""), ("c.jpg", None), ("z.jpg", "")],
        "File_Name string, Business_Name string")
    files = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",), ("d.jpg",)], "file_name string")
    got = {r.File_Name: r.state for r in split_results(rows, files).collect()}
    assert got == {"a.jpg": "completed", "b.jpg": "placeholder", "c.jpg": "placeholder",
                   "z.jpg": "outside"}
    from purchaseflow.operators.state import pending_from_results
    pend = sorted(r.file_name for r in pending_from_results(files, rows).collect())
    assert pend == ["b.jpg", "c.jpg", "d.jpg"]


def test_running_counts_match_a_plain_window(spark, sf_small):
    att = fx.f6_attempts(spark, sf_small)
    ok = F.col("status") == "ok"
    two_level = running_counts(att, ["run_id"], "attempt_seq", {"oks": ok}, bucket_width=7)
    w = Window.partitionBy("run_id").orderBy("attempt_seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = att.select("run_id", "attempt_seq", F.count(F.lit(1)).over(w).alias("n"),
                       F.sum(F.when(ok, 1).otherwise(0)).over(w).alias("oks"))
    a = sorted(two_level.select("run_id", "attempt_seq", "n", "oks").collect())
    b = sorted(plain.collect())
    assert a == b


def plain_items(prediction):
    """The pivot as nested loops over one document's cells."""
    out = []
    for f in prediction or []:
        if f["label"] != "table":
            continue
        cells = f["cells"] or []
        for d in cells:
            if d["label"] != "Description":
                continue
            found = [next((c["text"] for c in cells if c["label"] == k and c["row"] == d["row"]), None)
                     for k in ("Price", "Quantity")]
            if d["text"] and all(found):
                out.append((d["row"], d["text"], *found))
    return out


def labelled_docs(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc long, body string").select(
        "doc", F.lit("same.jpg").alias("file_name"), parse_labelled(F.col("body")).alias("prediction"))


def test_cell_pivot_matches_nested_loops(spark):
    rng = random.Random(4)
    bodies = []
    for _ in range(60):
        fields = []
        for _ in range(rng.choice([0, 1, 2])):
            cells = [{"label": rng.choice(["Description", "Price", "Quantity", "Total"]), "row": rng.choice([None, 1, 2, 3, 7]),
                      "text": rng.choice(["x", "$2.00", "3", "", None])} for _ in range(rng.choice([0, 1, 4, 30]))]
            fields.append({"label": "table", "cells": rng.choice([cells, cells, None])})
        bodies.append(json.dumps({"result": [{"prediction": fields + [{"label": "Merchant_Name", "ocr_text": "M"}]}]}))
    docs = labelled_docs(spark, bodies + ["{not json", "{}"])
    got = {}
    for r in labelled_items(docs, ["doc", "file_name"]).orderBy("doc", "field_pos", "desc_pos").collect():
        got.setdefault(r.doc, []).append((r.row, r.description, r.price_text, r.quantity_text))
    want = {i: plain_items(json.loads(b)["result"][0]["prediction"]) for i, b in enumerate(bodies)}
    assert got == {i: w for i, w in want.items() if w}
    totals = {r.doc: r.n_items for r in labelled_receipts(docs, ["doc", "file_name"]).collect()}
    assert totals == {**{i: len(w) for i, w in want.items()}, 60: 0, 61: 0}


def test_documents_with_one_name_do_not_mix(spark):
    def body(price):
        return json.dumps({"result": [{"prediction": [{"label": "table", "cells": [
            {"label": "Description", "row": 1, "text": "x"}, {"label": "Price", "row": 1, "text": price},
            {"label": "Price", "row": 1, "text": "9.99"}, {"label": "Quantity", "row": 1, "text": "3"},
            {"label": "Description", "row": 1, "text": "y"}, {"label": "Description", "row": 2, "text": "z"},
            {"label": "Price", "row": 2, "text": "1.5"}]}, {"label": "Merchant_Name", "ocr_text": "A"},
            {"label": "Merchant_Name", "ocr_text": price}]}]})

    docs = labelled_docs(spark, [body("1.00"), body("2.00")])
    items = [(r.doc, r.description, r.price, r.quantity) for r in labelled_items(docs, ["doc"]).orderBy("doc", "desc_pos").collect()]
    assert items == [(0, "x", 1.0, 3), (0, "y", 1.0, 3), (1, "x", 2.0, 3), (1, "y", 2.0, 3)]
    assert {r.doc: r.subtotal for r in labelled_receipts(docs, ["doc"]).collect()} == {0: 2.0, 1: 4.0}
    assert {r.doc: r.business_name for r in dispatch_labels(docs).collect()} == {0: "1.00", 1: "2.00"}


def test_wide_keys_keep_their_names_apart(spark):
    keys = spark.createDataFrame([(12345678901,), (12345678904,), (7,)], "k long")
    assert [r[0] for r in keys.select(fx.file_name_of(F.col("k"))).collect()] == [
        "12345678901.jpeg", "12345678904.jpeg", "000000007.jpeg"]


def test_a_row_of_many_descriptions_takes_time_in_proportion(spark):
    n = 40_000
    cells = [{"label": "Price", "row": 1, "text": "$2.50"}, {"label": "Quantity", "row": 1, "text": "3"}]
    cells[1:1] = [{"label": "Description", "row": 1, "text": f"item {i}"} for i in range(n)]
    body = json.dumps({"result": [{"prediction": [{"label": "table", "cells": cells}]}]})
    docs = spark.createDataFrame([("d", body)], "doc string, body string").select("doc", parse_labelled(F.col("body")).alias("prediction"))
    got = labelled_items(docs, ["doc"]).agg(F.count("*"), F.sum("quantity"), F.sum("price"), F.countDistinct("description")).first()
    assert tuple(got) == (n, 3 * n, 2.5 * n, n)


def test_no_checkpoint_is_left(spark, sf_small):
    """Running counts are checkpointed; their files go with the other scratch data."""
    counted = running_counts(fx.f6_attempts(spark, sf_small), ["run_id"], "attempt_seq", {})
    path = next(p for s, p in reversed(session._SCRATCH) if "/rdd-" in p)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert counted.count() > 0 and fs.exists(files)
    session.drop_scratch(spark, path)
    assert not fs.exists(files)
