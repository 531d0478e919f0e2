"""Stupid-backoff scores against plain counting and against SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from purchaseflow.llm import lm, queries


def brute(rows):
    docs = {}
    for d, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        docs[d] = re.findall(r"[^\x20\x09-\x0D]+", t)
    one, two, started = Counter(), Counter(), 0
    for w in docs.values():
        one.update(w)
        two.update(zip([None, *w], w))
        started += bool(w)
    total = sum(one.values())
    out = {}
    for d, w in docs.items():
        s = [math.log10(two[a, b] / (one[a] if a is not None else started)) if two[a, b] >= 2
             else math.log10(0.4 * one[b] / total) for a, b in zip([None, *w], w)]
        out[d] = (len(w), sum(s) / len(s) if s else 0.0)
    return out


def compare(got, want):
    assert {r.doc_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert r.n_words == want[r.doc_id][0]
        assert r.score == pytest.approx(want[r.doc_id][1], abs=2e-6)


@pytest.mark.parametrize("seed, hot", [(1, 1 / 4096), (2, 0.05), (3, 0.9)])
def test_matches_plain_counting(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["The"] * 60 + ["of"] * 30 + ["É"]
    rows = [(rng.randrange(-10**12, 10**12), "".join(w + rng.choice([" ", "\n", " \t"]) for w in rng.choices(words, k=rng.choice([0, 1, 2, 30, 200]))))
            for _ in range(120)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, blob string")
    compare(lm.scores(docs.repartition(4)).collect(), brute(rows))


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, "alone"), (4, "a b a b A B"), (5, "a b"), (6, "long " * 50000)]
    docs = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string")
    compare(lm.scores(docs).collect(), brute(rows))
    twice = {r.doc_id: r.n_words for r in lm.scores(docs.unionAll(docs)).collect()}
    assert twice == {d: 2 * len((t or "").split()) for d, t in rows}
    assert lm.scores(docs.filter("false")).count() == 0


def test_query_matches_sql_on_a_whole_table(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_small}/documents.parquet')")
    want = {d: (n, s) for d, n, s in con.execute(lm.ORACLE_SQL).fetchall()}
    compare(queries.QUERIES["op5_lm"](spark, sf_small).collect(), want)
