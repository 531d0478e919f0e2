"""The manifest against a plain level-by-level tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from purchaseflow.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return h(*map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text)))


def grow(nodes):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    """Per level the (left, right) siblings of a node."""
    steps = []
    for level in levels[:-1]:
        a = i - i % 2
        steps.append((level[a:i], level[i + 1:a + 2]))
        i //= 2
    return steps


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, grow([leaf(r) for r in mine])))
    top = grow([levels[-1][0] for _, levels in trees])
    for k, (mine, levels) in enumerate(trees):
        for i, r in enumerate(mine):
            steps = path(levels, i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1 if hit else 0)
            for before, after in steps:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h(*[s for a, b in steps for s in (*a, *b)]), node, node == top[-1][0]))
    return sorted(out, key=str)


def result(docs, levels):
    return sorted(map(tuple, merkle.verified(merkle.manifest(docs, *merkle.tampered(), levels=levels)).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 10])
@pytest.mark.parametrize("n", [1, 33])
def test_equals_a_plain_tree(spark, levels, n):
    rows = [(i * 3, f"s{i}", ["en", "de", None, "é"][min(i % 7, 3)], i, f"text {i} é") for i in range(n)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(3), levels) == brute(rows)


def test_nulls_repeats_long_texts_and_other_columns(spark):
    rows = [(None, None, None, None, None), (7, None, "en", None, ""), (7, "a", "en", 3, "x"), (7, "a", "en", 3, "x"),
            (None, "a", "en", 1, "y"), (8, "", "", 0, ""), (9, "a", "-", 2**63 - 1, "z" * 300_000), (-1, "a", "en", 1, "y")]
    rows += [(5, "a", "en", 3, "same")] * 40
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA + ", grp string, pos int")
    assert result(docs, 2) == brute(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA), 10) == []


def test_query_covers_all_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = sorted(map(tuple, queries.op12_merkle(spark, sf_small).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()])


def test_a_changed_witness_is_not_verified(spark):
    rows = [(i, "s", "en", i, "t") for i in range(9)]
    proofs = merkle.manifest(spark.createDataFrame(rows, SCHEMA), levels=2)
    assert merkle.verified(proofs).filter("NOT verified").count() == 0
    broken = proofs.withColumn("witness", F.transform("witness", lambda s: F.translate(s, "0", "1")))
    assert merkle.verified(broken).filter("verified").count() == 0
