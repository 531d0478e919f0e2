"""The pipeline's stages, each on its own input, and the whole run."""

from __future__ import annotations

import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from purchaseflow.llm import quality, stages, toxicity
from purchaseflow.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return table(spark, sf_small, "documents")


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]


@pytest.mark.parametrize("stage, module, label", [(stages.without_toxic, toxicity, 1), (stages.with_quality, quality, 0)])
def test_filters_drop_what_their_operator_rejects(spark, docs, sf_small, stage, module, label):
    kept = stage(spark, docs, sf_small)
    assert kept.columns == COLUMNS
    rejected = {r.doc_id for r in module.classify(docs, table(spark, sf_small, "labels")).collect() if r.predicted == label}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected
    assert rejected


def test_one_document_of_each_group_stays(spark, sf_small):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(100)]
    near = list(base)
    near[50] = "changed"
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (9, " ".join(rng.choices(base, k=100))), (8, None), (7, "")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, component_id int")
    kept = stages.without_near_copies(spark, docs, sf_small)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7, 8, 9]


def test_texts_that_share_an_id_or_have_none_are_judged_by_themselves(spark, sf_small):
    rng = random.Random(2)
    one, two, three = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(3))
    rows = [(1, one, "b"), (1, two, "a"), (1, two, "b"), (None, three, "a"), (None, one, "a"), (2, two, "a"), (None, None, "a"),
            (None, None, "a"), (None, "few words", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, row_key string")
    kept = stages.without_near_copies(spark, docs, sf_small)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted((t or "" for _, t, _, _ in got)) == sorted([one, two, three, "", "few words"])
    assert (2, two, "a", "x") in got  # the smallest id that is one row's alone
    spans = [tuple(r) for r in stages.without_repeats(spark, docs, sf_small).collect()]
    assert sum(len((t or "").split()) for _, t, _, _ in spans) >= 3 * 80 + 2
    assert {t for _, t, _, _ in spans} >= {three, None, "few words"} and len(spans) == len(rows)


def test_filters_keep_clean_rows_without_an_id(spark, docs, sf_small):
    some = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")))
    for stage in (stages.without_toxic, stages.with_quality):
        assert stage(spark, some, sf_small).filter("doc_id IS NULL").count() > 0


def test_repeated_passages_go_and_clean_texts_stay(spark, sf_small):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, f"own\nstart {passage}  end"), (2, f"other {passage} tail"), (3, " clean  text\n"), (4, None), (None, passage)]
    docs = spark.createDataFrame([(*r, 0, 7) for r in rows], "doc_id int, text string, span_starts int, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.without_repeats(spark, docs, sf_small).collect()}
    assert got == {1: (rows[0][1], 7), 2: ("other tail", 10), 3: (" clean  text\n", 7), 4: (None, 7), None: ("", 0)}


def test_whole_run(spark, sf_small, docs):
    pieces = corpus_pipeline.run(spark, sf_small).collect()
    kept = {p.doc_id for p in pieces}
    assert kept < {r.doc_id for r in docs.collect()} and len(kept) > docs.count() // 2
    ends = {}
    for p in pieces:
        ends.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, parts in ends.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 4096 or s == max(ends)


def test_empty_documents(spark, sf_small, docs):
    empty = docs.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).count() == 0


def test_trim_gives_back_what_the_arrow_pool_keeps():
    # In a process of its own: how much other tests have freed doesn't matter.
    code = """
import re
import pyarrow as pa
from purchaseflow.llm.common import trim
def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024
trim()
before = mb()
kept = [pa.array([b"x" * 5000] * 1000, pa.binary()) for _ in range(50)]
held = mb() - before
del kept
trim()
print(held, mb() - before)
"""
    held, left = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert held > 80 and left < 0.2 * held
