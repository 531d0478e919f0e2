"""The Jaccard join against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest

from purchaseflow.llm import jaccard, queries


def brute(rows, words, percent):
    sets = []
    for doc, text in rows:
        w = [x.encode().lower().decode() if x.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
             for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append((doc, {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    return {d: (len(s), find(d)) for d, s in sets}


def corpus(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Straße", "X"]
    passage = rng.choices(words, k=25)
    texts = []
    while len(texts) < n:
        kind = rng.random()
        base = rng.choices(words, k=rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 13, 16, 17, 20, 40, 90, 200]))
        if kind < 0.2:
            base += passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):  # chains of edits
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                if base:
                    at = rng.randrange(len(base))
                    edit = rng.random()
                    if edit < 0.4:
                        base[at] = rng.choice(words)
                    elif edit < 0.7:
                        del base[at]
                    else:
                        base.insert(rng.choice([0, len(base)]), rng.choice(words))
            texts.append(base)
    spaces = [" ", "\n", "  ", "\t"]
    return ["".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in [x for p in t for x in (p, rng.choice(spaces))])
            for t in texts[:n]]


@pytest.mark.parametrize("seed, words, percent, vocabulary", [(1, 4, 85, 400), (2, 5, 80, 400), (3, 1, 85, 30), (4, 2, 60, 200)])
def test_components_match_all_pairs(spark, monkeypatch, seed, words, percent, vocabulary):
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 3)
    rows = list(enumerate(corpus(seed, 260, vocabulary)))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, set_id string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, words, percent).collect()}
    assert got == brute(rows, words, percent)


def test_small_sets_alone_and_lists_alone(spark, monkeypatch):
    rows = list(enumerate(corpus(5, 200)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4, 85)
    for boundary in (1, 24):
        monkeypatch.setattr(jaccard._Join, "boundary", lambda self, classes, mean: boundary)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(docs, 4, 85).collect()}
        assert got == want


def test_split_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "HEAVY_FROM", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        t = list(base)
        t[rng.randrange(60)] = f"r{rng.random()}"
        texts.append(" ".join(t))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_hard_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "ONE two"), (4, "one two three four"), (3, "one two three"),
            (20, long), (21, long + " more"), (22, long), (22, long)]
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(docs, 4, 85).collect())
    assert got == [(3, 1, 3), (4, 1, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8),
                   (20, 29997, 20), (21, 29998, 20), (22, 29997, 20), (22, 29997, 20)]
    assert jaccard.components(docs.filter("false"), 4, 85).count() == 0


def test_query_matches_all_pairs_on_a_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_jaccard"](spark, sf_small).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs], 4, 85)
