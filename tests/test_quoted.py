"""Result files with line breaks inside quotes, read in byte ranges (SRC4)."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from purchaseflow.schemas import RESULT_COLUMNS
from purchaseflow.sources.quoted import read_fields, read_records
from purchaseflow.sources.results import CSV_OPTIONS, read_results

HARD = ["plain", "", "two\nlines", 'a "quoted" word', '"', '""', "pipe | here", "\n", "\n\n\n", "end\n", "\\", 'x\n"y"\n|z', " padded ",
        "é\n語", "long " * 30 + "\n" + '"' * 7, "line\r\nbreak", "a" * 100]


def written(rows, columns, ending="\n"):
    out = io.StringIO()
    w = csv.writer(out, delimiter="|", lineterminator=ending)
    w.writerow(columns)
    w.writerows(rows)
    return out.getvalue().encode()


@pytest.fixture
def small_ranges(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size, n", [(37, 12), (400, 120), (1 << 27, 120)])
def test_records_do_not_depend_on_the_ranges(spark, tmp_path, small_ranges, size, n):
    rng = random.Random(size)
    rows = [[str(i), *rng.choices(HARD, k=3)] for i in range(n)]
    (tmp_path / "one.csv").write_bytes(written(rows, ["k", "a", "b", "c"]))
    (tmp_path / "two.csv").write_bytes(written([[r[2], r[0] + "x", r[1]] for r in rows], ["b", "k", "a"]))
    small_ranges(size)
    got = {r.k: (r.a, r.b, r.c) for r in read_fields(spark, str(tmp_path), ["k", "a", "b", "c"], CSV_OPTIONS).collect()}
    want = {r[0]: tuple(x or None for x in r[1:]) for r in rows}
    want |= {r[0] + "x": (r[1] or None, r[2] or None, None) for r in rows}
    assert got == want
    if size < 1000:
        assert read_records(spark, str(tmp_path))[0].select("range").distinct().count() > 5


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    rows = [[f"f{i}.jpg", "Shop | 1", "", "", 'x "y"\n' * (i % 5), 1.5, 0, i, 0, f"text\n{i}", "{}"] for i in range(2000)]
    (tmp_path / "results.csv").write_bytes(written(rows, RESULT_COLUMNS))
    small_ranges(1 << 13)
    df = read_results(spark, str(tmp_path / "results.csv"))
    got = {r.File_Name: (r.Business_Name, r.Items, r.Total, r.Raw_OCR, r.bad_fields) for r in df.collect()}
    assert got == {r[0]: (r[1], r[4] or None, float(r[7]), r[9], "") for r in rows}
    records, headers = read_records(spark, str(tmp_path / "results.csv"))
    assert headers.count() == 1 and records.select(F.spark_partition_id()).distinct().count() > 5


def test_files_of_other_column_order_and_line_ends(spark, tmp_path):
    a = dict(zip(RESULT_COLUMNS, ["f.jpg", "Shop", "", "", "", 1, 2, 3, 4, "", "{}"]))
    (tmp_path / "a.csv").write_bytes(written([a.values()], a.keys()))
    b = {**{k: a[k] for k in reversed(RESULT_COLUMNS) if k != "Tax"}, "File_Name": "g.jpg", "More": "?"}
    (tmp_path / "b.csv").write_bytes(written([b.values(), []], b.keys(), "\r\n"))
    (tmp_path / "c.csv").write_bytes(b"File_Name|Business_Name\n")
    (tmp_path / "d.csv").write_bytes(b"")
    got = {r.File_Name: (r.Business_Name, r.Subtotal, r.Tax, r.Extracted_JSON) for r in read_results(spark, str(tmp_path)).collect()}
    assert got == {"f.jpg": ("Shop", 1.0, 2.0, "{}"), "g.jpg": ("Shop", 1.0, None, "{}")}


def test_many_files_in_one_task(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.csv").write_bytes(written([[i, HARD[i % len(HARD)]], [f"{i}b", "z"]], ["k", "a"] if i % 2 else ["k", "a"]))
    got = {r.k: r.a for r in read_fields(spark, str(tmp_path), ["a", "k"], CSV_OPTIONS).collect()}
    assert got == {**{str(i): HARD[i % len(HARD)] or None for i in range(30)}, **{f"{i}b": "z" for i in range(30)}}
