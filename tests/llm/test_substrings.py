"""Substring dedup against a brute-force scan of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from purchaseflow.llm import queries, substrings
from purchaseflow.llm.words import run_mask


def brute(rows, window):
    docs = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] != (d, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "Straße", "a b", "x\x1cy"]
    passages = [rng.choices(words, k=k) for k in (19, 20, 21, 45, 80)]
    texts = []
    for _ in range(n):
        t = rng.choices(words, k=rng.choice([0, 1, 10, 19, 20, 40, 100]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            t[rng.randint(0, len(t)):0] = rng.choice(passages)
        if rng.random() < 0.2:
            t = [rng.choice(words)] * rng.choice([19, 20, 21, 70])
        if texts and rng.random() < 0.2:
            t = list(rng.choice(texts))
        texts.append(t)
    ids = rng.sample(range(-50, 10 * n), n)
    return [(d, "".join(x for w in t for x in (w, rng.choice([" ", "\n", "\t\r", " \x0b\x0c"])))) for d, t in zip(ids, texts)]


def result(df):
    rows = substrings.kept_digests(df).collect()
    return rows, {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}


@pytest.mark.parametrize("seed, window, group, partitions", [(1, 20, 1 << 20, 1), (2, 20, 3, 4), (3, 5, 2, 3), (4, 2, 1, 2)])
def test_matches_all_windows(spark, monkeypatch, seed, window, group, partitions):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = corpus(seed, 150)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, starts int, kept string")
    got, by_doc = result(substrings.deduplicated(docs.repartition(partitions), window))
    assert len(got) == len(rows)
    assert by_doc == brute(rows, window)


def test_hard_rows(spark):
    long = " ".join(f"t{i % 900}" for i in range(40000))
    rows = [(1, None), (2, ""), (3, "one two"), (9, long), (8, long), (7, "a " * 40), (6, "b " * 20)]
    docs = spark.createDataFrame([*rows, (None, long), (8, long), (7, "a " * 40)], "doc_id long, text string")
    got, by_doc = result(substrings.deduplicated(docs))
    assert len(got) == len(rows) + 2
    assert by_doc == brute(rows, 20)
    assert substrings.deduplicated(docs.filter("false")).count() == 0


def test_run_mask_keeps_runs_within_rows():
    rng = np.random.default_rng(4)
    for k in (1, 2, 5, 20):
        sizes = rng.choice([0, 0, 1, 2, 5, 21, 30], 40)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        n = int(firsts[-1])
        want = [i for a, b in zip(firsts, firsts[1:]) for i in range(a, b - k + 1)]
        assert np.flatnonzero(run_mask(firsts, n, k)).tolist() == want


def test_query_matches_all_windows_on_a_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op6_substrings"](spark, sf_small).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs], 20)
