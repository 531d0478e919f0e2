"""File-system behaviour: folder scan (SRC1, F8), type filter (SRC3), slices (SRC2),
result file read/write (SRC4, SRC5, SNK1), skipped list (SNK4), JSON export (SNK5)
and resumable streaming ingest of an image folder (SRC9)."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from purchaseflow.operators import selection
from purchaseflow.schemas import RESULT_COLUMNS
from purchaseflow.sinks.outputs import receipt_json, write_results, write_skipped
from purchaseflow.sources.files import image_type_filter, scan_images, slice_files
from purchaseflow.sources.results import read_results
from purchaseflow.streaming.ingest import ingest_once, read_ingested

F8_IMAGES = ["a b.jpg", "c+d.png", "e#f.jpeg", "é.jpg", "plain.jpg"]
F8_OTHER = ["UPPER.JPG", "notes.txt", ".hidden.jpg", "sub/inner.jpg"]


def make_folder(root, names):
    for n in names:
        p = os.path.join(root, n)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(b"\xff\xd8" + n.encode())


def test_folder_scan_rules(spark, tmp_path):
    make_folder(str(tmp_path), F8_IMAGES + F8_OTHER)
    got = sorted(r.file_name for r in scan_images(spark, str(tmp_path)).collect())
    assert got == sorted(F8_IMAGES)
    with_content = scan_images(spark, str(tmp_path), with_content=True)
    assert all(r.length == len(r.content) for r in with_content.collect())


def test_type_filter_any_case(spark):
    df = spark.createDataFrame([(n,) for n in ["a.JPG", "b.png", "c.gif", "d"]], "file_name string")
    assert sorted(r.file_name for r in image_type_filter(df).collect()) == ["a.JPG", "b.png"]


def test_slices_match_a_sorted_list(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "url", F.lit(b"x").alias("content"))
    ids = [r.page_id for r in sorted(pages.collect(), key=lambda r: (r.url, r.page_id))]
    for start, end in ((0, 1), (5, 30), (0, len(ids)), (len(ids) - 3, len(ids) + 10), (7, 7), (len(ids), len(ids) + 1)):
        got = [r.page_id for r in slice_files(pages, start, end, ["url", "page_id"]).collect()]
        assert sorted(got) == sorted(ids[start:end])
    assert slice_files(pages, None, 30).count() == pages.count()
    with pytest.raises(ValueError):
        slice_files(pages, -1, 3)


def test_slices_with_ties_and_nulls(spark):
    names = [None, "a", "a", "a", "b", None, "c", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "n int, file_name string").repartition(3)
    ordered = sorted(names, key=lambda x: (x is not None, x or ""))
    for start in range(9):
        for end in range(start, 10):
            got = [r.file_name for r in slice_files(df, start, end).collect()]
            assert sorted(got, key=str) == sorted(ordered[start:end], key=str)
    halves = slice_files(df, 0, 3).unionAll(slice_files(df, 3, 8))
    assert sorted(r.n for r in halves.collect()) == list(range(8))


@pytest.mark.parametrize("sample, margin", [(8, 0.1), (40, 4.0)])
def test_slices_by_a_small_sample(spark, monkeypatch, sample, margin):
    """Enclosing keys that miss a place are found out; a constant order is settled by the rest."""
    monkeypatch.setattr(selection, "SAMPLE", sample)
    monkeypatch.setattr(selection, "MARGIN", margin)
    rows = [(1, "same", (i * 7919) % 1000, b"x") for i in range(1000)] + [(2, None, 5, None)] * 60
    df = spark.createDataFrame(rows, "k int, name string, n int, content binary").repartition(5)
    ordered = sorted((r[:3] for r in rows), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    for start, end in ((0, 3), (400, 650), (990, 1030), (1010, 1020), (1059, 2000)):
        got = [(r.k, r.name, r.n) for r in slice_files(df, start, end, ["k"]).collect()]
        assert sorted(got, key=str) == sorted(ordered[start:end], key=str)


def test_a_slice_is_one_filtered_scan(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    plan = slice_files(pages, 5, 30, ["url", "page_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(url" in plan and "Exchange" not in plan


def test_result_file_roundtrip_and_na(spark, tmp_path):
    rows = [("x.jpg", 'A | "B"', "  pad  ", "", "1x a ($1.00)", 1.0, 0.0, 1.0, 0.5, "l1\nl2|l3", "{}"),
            ("y.jpg", "N/A", None, "01-01-2020", "", 0.0, 0.0, 0.0, 0.0, "\\back", "{}")]
    df = spark.createDataFrame(rows, ",".join(f"{c} {'double' if c in ('Subtotal','Tax','Total','Processing_Time_Seconds') else 'string'}" for c in RESULT_COLUMNS))
    path = str(tmp_path / "results")
    write_results(df, path)
    back = {r.File_Name: r for r in read_results(spark, path).collect()}
    assert back["x.jpg"].Business_Name == 'A | "B"' and back["x.jpg"].Raw_OCR == "l1\nl2|l3"
    assert back["x.jpg"].Business_Address == "  pad  " and back["y.jpg"].Raw_OCR == "\\back"
    assert back["y.jpg"].Business_Name is None  # pandas NA token reads back as missing
    assert read_results(spark, str(tmp_path / "missing")).count() == 0


def test_skipped_list(spark, tmp_path):
    empty = spark.createDataFrame([], "path string")
    assert write_skipped(empty, str(tmp_path / "none")) is False
    one = spark.createDataFrame([("/d/a.jpg",), ("/d/b.jpg",)], "path string")
    assert write_skipped(one, str(tmp_path / "skipped")) is True
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "skipped")).collect()) == ["/d/a.jpg", "/d/b.jpg"]


def test_json_export_keeps_nulls(spark):
    df = spark.createDataFrame([(None, "01-01-2020", 1.5)], "n string, d string, t double")
    items = F.array().cast("array<struct<description:string,quantity:double,price:double>>")
    text = df.select(receipt_json(F.col("n"), F.col("d"), items, F.col("t"), F.lit(None).cast("double"),
                                  F.col("t"))).first()[0]
    assert json.loads(text) == {"business_name": None, "date": "01-01-2020", "items": [],
                                "subtotal": 1.5, "tax": None, "total": 1.5}
    assert "\n" in text


def test_stream_ingest_of_image_folder(spark, tmp_path):
    src, sink, ck = (str(tmp_path / p) for p in ("src", "sink", "ck"))
    os.makedirs(src)
    make_folder(src, F8_IMAGES[:3] + ["skip.txt"])
    ingest_once(spark, src, sink, ck, 1)
    ingest_once(spark, src, sink, ck, 2)  # nothing new
    make_folder(src, ["late.png"])
    ingest_once(spark, src, sink, ck, 3)
    got = {r.file_name: r.ingest_run for r in read_ingested(spark, sink).collect()}
    assert got == {"a b.jpg": 1, "c+d.png": 1, "e#f.jpeg": 1, "late.png": 3}


def test_zero_byte_result_file_starts_fresh(spark, tmp_path):
    empty = tmp_path / "results.csv"
    empty.write_bytes(b"")
    df = read_results(spark, str(empty))
    assert df.count() == 0
    assert df.columns == [*RESULT_COLUMNS, "bad_fields"]


def test_columns_are_found_by_name(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text("Business_Name|File_Name|Total|Tax|Notes\nShop|a.jpg|1.5|n/a|x\nNULL|b.jpg|abc|2|y\n")
    got = {r.File_Name: r for r in read_results(spark, str(path)).collect()}
    assert got["a.jpg"].Business_Name == "Shop" and got["a.jpg"].Total == 1.5 and got["a.jpg"].Tax is None
    assert got["b.jpg"].Business_Name is None and got["b.jpg"].Total is None and got["b.jpg"].Subtotal is None
    assert (got["a.jpg"].bad_fields, got["b.jpg"].bad_fields) == ("", "Total")


def test_na_tokens_are_missing_in_every_column(spark, tmp_path):
    path = tmp_path / "na.csv"
    path.write_text("File_Name|Business_Address|Date|Raw_OCR\na.jpg|NA|null|nan\n")
    r = read_results(spark, str(path)).first()
    assert (r.Business_Address, r.Date, r.Raw_OCR, r.bad_fields) == (None, None, None, "")
    assert read_results(spark, str(path), na_as_missing=False).first().Business_Address == "NA"


def test_an_unreadable_location_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        read_results(spark, "nosuchscheme://x/y").count()
