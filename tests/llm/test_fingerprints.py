"""Edit-embedding fingerprints: a plain walk, the order of ids, edits and classes."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from purchaseflow.llm import fingerprints as fp
from purchaseflow.llm import queries


def plain(text):
    """One walk, one character at a time, with the library's shared draws."""
    codes, lengths = fp._codes([text])
    n = len(text)
    sampled = set(fp.sampled_steps(fp.level_of(n)).tolist())
    i, bits = 0, []
    for j in range(3 * n):
        if i >= n:
            break
        move, emit = (int(fp._draws(j, j + 1, salt)[0] >> np.uint64(32)) | 1 for salt in (2, 3))
        if j in sampled:
            bits.append(int(codes[i]) * emit % (1 << 32) >> 31)
        i += int(codes[i]) * move % (1 << 32) >> 31
    return fp.level_of(n), bits


def sample_texts():
    rng = random.Random(1)
    letters = "abcdefghij klm é日\n\0"
    return ["", "a", "ab", *["".join(rng.choices(letters, k=rng.choice([1, 5, 60, 63, 64, 300, 511, 512, 700]))) for _ in range(25)], "z" * 2500]


def test_walks_side_by_side_match_a_plain_walk():
    texts = sample_texts()
    for text, (level, bits) in zip(texts, fp.walked(texts)):
        assert (level, bits.tolist()) == plain(text)


def test_pieces_and_company_change_nothing(monkeypatch):
    texts = sample_texts()
    want = list(map(fp.to_text, fp.walked(texts)))
    monkeypatch.setattr(fp, "CHARACTERS", 100)
    assert list(map(fp.to_text, fp.walked(texts))) == want
    assert [fp.to_text(fp.walked([t])[0]) for t in texts] == want
    assert all(fp.to_text(fp.from_text(t)) == t for t in want)


def test_likeness_falls_with_edits():
    rng = random.Random(2)

    def edited(text, k):
        x = list(text)
        for _ in range(k):
            i = rng.randrange(len(x))
            x[i:i + rng.choice([0, 1])] = rng.choice([[], ["q"]])
        return "".join(x)

    texts = ["".join(rng.choices("abcdefgh ", k=1500)) for _ in range(40)]
    means = [np.mean([fp.likeness(*fp.walked([t, edited(t, k)])) for t in texts]) for k in (0, 5, 40, 400)]
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3] and means[1] > 0.85
    assert np.mean([fp.likeness(*fp.walked([a, b])) for a, b in zip(texts, texts[1:])]) < 0.15


def check_edits(rows, got):
    ordered = sorted(rows)
    want = {}
    for (d, t), (_, nxt) in zip(ordered, [*ordered[1:], *ordered[:1]]):
        q = len(t) // 4
        want[d] = (t, t[:len(t) - q] + nxt[:q], nxt)
    assert len(got) == len(rows)
    for r in got:
        t, edited, nxt = want[r.doc_id]
        own, changed, after = fp.walked([t, edited, nxt])
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp.to_text(own) and r.edited_fingerprint == fp.to_text(changed)
        assert r.near_edited == pytest.approx(fp.likeness(own, changed))
        assert r.near_next == pytest.approx(fp.likeness(own, after))


@pytest.mark.parametrize("n", [1, 2, 7, 90])
def test_the_next_document_in_ascending_order(spark, monkeypatch, n):
    rng = random.Random(n)
    ids = rng.sample(range(-500, 500), n)
    rows = [(d, "".join(rng.choices("ab cdé", k=rng.choice([0, 1, 3, 4, 50])))) for d in ids]
    docs = spark.createDataFrame([(d, t or None, 0, "x") for d, t in rows], "doc_id long, text string, bucket int, fingerprint string")
    check_edits(rows, fp.with_edits(docs.repartition(3)).collect())


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (2, None), (None, "x"), (3, "long " * 30000)], "doc_id long, text string")
    got = fp.with_edits(docs).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert fp.with_edits(docs.filter("false")).count() == 0
    assert fp.near_classes(docs.filter("false")).count() == 0


def test_classes_join_near_copies_only(spark):
    rng = random.Random(3)
    base = ["".join(rng.choices("abcdefgh ", k=rng.choice([400, 505, 520, 2000]))) for _ in range(30)]
    rows = []
    for i, t in enumerate(base):
        near = t[:200] + "X" + t[200:]
        rows += [(10 * i, t), (10 * i + 1, t), (10 * i + 2, near)]
    got = {r.doc_id: r.class_id for r in fp.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] % 10 == 0 and got[d] // 10 == d // 10 or got[d] == d for d in got)
    assert np.mean([got[10 * i + 2] == 10 * i for i in range(30)]) > 0.8
    assert all(got[10 * i + 1] == 10 * i for i in range(30))


def test_query_on_a_whole_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    check_edits([(r.doc_id, r.text or "") for r in docs], queries.QUERIES["op2_fingerprints"](spark, sf_small).collect())


def check_classes(spark, rows, least=fp.LIKENESS):
    """Classes against all pairs; returns the number of links between different texts."""
    marks = fp.walked([t for _, t in rows])
    root = {d: d for d, _ in rows}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    links = 0
    for i, (a, s) in enumerate(rows):
        for j in range(i):
            if fp.likeness(marks[i], marks[j]) >= least:
                links += s != rows[j][1]
                x, y = sorted((top(a), top(rows[j][0])))
                root[y] = x
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in fp.near_classes(docs, least).collect()}
    assert got == {d: top(d) for d, _ in rows}
    return links


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("kind", ["short", "header", "early", "levels"])
def test_classes_lose_no_link(spark, monkeypatch, kind, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    rng = random.Random(5)

    def some(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    header = some(260)
    rows = []
    for _ in range(25):
        t = {"short": lambda: some(rng.randrange(1, 190)), "header": lambda: header + some(rng.choice([60, 240])),
             "early": lambda: some(rng.choice([300, 900])), "levels": lambda: some(rng.choice([509, 512, 1020, 1026, 2046]))}[kind]()
        rows.append(t)
        for _ in range(3):
            i = rng.randrange(min(len(t), 40)) if kind == "early" else rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "x", "xyz"]) + t[i + rng.choice([0, 1, 4]):]
            rows.append(t)
    rows = list(enumerate(rng.sample(rows, len(rows))))
    assert check_classes(spark, [*rows, (1000, ""), (1001, "")]) > 20


def test_classes_at_other_bounds(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("ab", k=rng.choice([3, 40, 400, 700])))) for i in range(60)]
    rows += [(100 + i, t[:len(t) * 3 // 4]) for i, t in rows]
    assert check_classes(spark, rows, 0.4) > 20
    check_classes(spark, rows, 1.0)
