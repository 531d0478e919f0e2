"""Quality and toxicity: held-out accuracy, exact votes, plain convolution, hard rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from purchaseflow.llm import quality, queries, toxicity
from purchaseflow.llm.common import text_bytes

MID = "/root/testdata/sf0.1"


def accuracy(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    return np.mean([r.predicted == known[r.doc_id] for r in held]), len(held)


@pytest.mark.parametrize("name, column, cutoff", [("op1_quality", "quality", 0.3), ("op9_toxicity", "toxic", 0.5)])
def test_held_out_accuracy_of_the_query(spark, name, column, cutoff):
    rows = queries.QUERIES[name](spark, MID).collect()
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cutoff) for r in rows)
    right, n = accuracy(rows, spark.read.parquet(f"{MID}/labels.parquet").collect(), column)
    assert n > 500 and right > 0.97


def hard_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a good text about nothing", 1.0), (1, "a good text about nothing", 1.0), (2, None, None), (3, "", 0.0),
         (4, "BUY!! NOW!! " * 3000, 2.0), (None, "no id", 0.0), (5, "a good text about nothing", 3.0), (6, "é", 1.0),
         (7, "BUY!! NOW!! BUY!!", 2.0), (8, "fine words here again", 2.0)],
        "doc_id long, text string, score double")
    labels = spark.createDataFrame(
        [(1, 1, 0), (4, 0, 1), (7, 0, 1), (8, 1, 0), (8, 1, 0), (None, 1, 1), (5, None, None), (99, 0, 0), (3, 7, 7)],
        "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_hard_rows(spark, module, column):
    docs, labels = hard_rows(spark)
    rows = module.classify(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 3, 4, 5, 6, 7, 8]
    assert len({r.score for r in rows if r.doc_id in (1, 5)}) == 1
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = labels.filter("false")
    assert {r.score for r in module.classify(docs, nothing).collect()} == {0.0}
    assert module.classify(docs.filter("false"), labels).count() == 0


def test_votes_match_brute_force_neighbours():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcd ,."), 80)) for _ in range(300)]
    raw, offsets = text_bytes(pa.array(texts))
    counts = quality.features(raw, offsets)
    labels = rng.integers(0, 2, 200)
    model = quality.fit(counts[:200], labels)
    got = model.scores(counts[200:])
    for v, score in zip(model.project(counts[200:]), got):
        cosines = [float(v @ w) for w in model.vectors]
        near = np.argsort(cosines)[-quality.NEIGHBOURS:]
        weights = np.array([max(cosines[i], 0.0) ** quality.POWER for i in near])
        assert score == pytest.approx((weights * labels[near]).sum() / weights.sum(), abs=1e-4)


def test_pooling_matches_a_plain_convolution(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(toxicity, "CHUNK", 7)  # windows cross chunks
    texts = ["", "one", "one two", *[" ".join(rng.choice(["ab", "cd", "ef", "gh!", "Ij"], n)) for n in (3, 30, 5, 1, 17)], ""]
    words = toxicity.Words.of(pa.array(texts))
    columns = sum(toxicity.WIDTHS) * toxicity.FILTERS
    tables = [rng.normal(size=(toxicity.BUCKETS + 1, toxicity.SIZE)).astype(np.float32) for _ in range(toxicity.SIDES)]
    places = rng.normal(size=(toxicity.SIZE, columns)).astype(np.float32)
    for t in tables:
        t[-1] = 0
    biases = rng.normal(size=(len(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32)
    model = toxicity.Model(tables, places, biases, np.ones(3 * toxicity.FILTERS), 0.0, np.zeros(len(toxicity.LANGUAGES)), 1.0)
    got = model.pooled(words)
    vectors = sum(t[b] for t, b in zip(tables, words.buckets())) @ places
    for d in range(len(texts)):
        mine = vectors[words.firsts[d]:words.firsts[d + 1]]
        column = 0
        for w, width in enumerate(toxicity.WIDTHS):
            want = np.zeros(toxicity.FILTERS)
            for i in range(len(mine)):
                total = biases[w].copy()
                for k in range(width):
                    if i + k < len(mine):
                        at = column + k * toxicity.FILTERS
                        total += mine[i + k, at:at + toxicity.FILTERS]
                want = np.maximum(want, total)
            column += width * toxicity.FILTERS
            assert got[d, w * toxicity.FILTERS:(w + 1) * toxicity.FILTERS] == pytest.approx(want, abs=1e-4)


def test_a_long_document_keeps_no_other_out_of_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(3)
    ids = [d for d in range(1, 400) if zlib.crc32(str(d).encode()) % 5]
    first = spark.createDataFrame([(d,) for d in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").first().doc_id
    rows = [(d, " ".join(rng.choice(["one", "two", "three"], 9)) + (" vile" if d % 2 else " fine"), d % 2) for d in ids]
    rows = [(d, t + " and more" * 4000 if d == first else t, y) for d, t, y in rows]
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 5000)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels).collect()
    assert len(sample) == len(ids) - 1 and {len(r.words) // 16 for r in sample} == {10}
    model = toxicity.train(docs, labels)
    assert [s > 0.5 for s in model.scores(toxicity.Words.of(pa.array(["one vile", "one fine"])))] == [True, False]


def test_words_of_the_sample_are_shared_by_the_classes(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 2000)

    def taken(clean, toxic):
        y = np.array([0] * len(clean) + [1] * len(toxic))
        some = toxicity.within_words(y, np.array(clean + toxic))
        return some[y == 0].tolist(), some[y == 1].tolist()

    assert taken([9] * 150, [9] * 50) == ([True] * 150, [True] * 50)  # what one class leaves, the other uses
    assert sum(taken([10] * 200, [10] * 200)[0]) == sum(taken([10] * 200, [10] * 200)[1]) == 100
    assert taken([990, 10, 5000, 10], [10] * 200)[0] == [False, True, False, True]
    assert taken([900, 10, 950, 10], [10] * 200)[0] == [True, True, False, True]
    assert taken([9000, 8000], [7000]) == ([False, True], [True])
    assert taken([], [5])[0] == []


def told_by_a_rare_word(spark):
    """Documents of random words; toxic ones hold one of 40 words, each in a few documents only."""
    rng = np.random.default_rng(5)
    rows = [(d, " ".join(rng.choice(["one", "two", "three", "four"], 12)) + (f" vile{d % 40:02d}" if d % 3 == 0 else f" fine{d % 40:02d}"),
             int(d % 3 == 0)) for d in range(1, 1500)]
    return (rows, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"),
            spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))


def test_counts_come_from_every_labelled_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 4000)  # many shards
    rows, docs, labels = told_by_a_rare_word(spark)
    docs = docs.union(docs.filter("doc_id % 7 = 0"))  # a repeated document counts once
    found = []
    monkeypatch.setattr(toxicity, "_weights", lambda shards, seen, n_docs: found.append((seen, n_docs, {
        r.doc_id for r in shards.collect()}, shards.select("shard").distinct().count())) or toxicity.Weights.start(seen, n_docs))
    toxicity.train(docs, labels)
    (seen, n_docs, ids, n_shards), = found
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    assert ids < {d for d, _, _ in known} and abs(len(ids) / len(known) - 0.75) < 0.05 and n_shards > 5
    want = np.zeros_like(seen)
    for d, text, y in known:
        if d in ids:
            for side, buckets in enumerate(toxicity.Words.of(pa.array([text])).buckets()):
                want[side, y, np.unique(buckets)] += 1
    assert (seen == want).all()
    assert n_docs.tolist() == [sum(y == c and d in ids for d, _, y in known) for c in (0, 1)]


def test_weights_and_thresholds_come_from_every_labelled_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 20_000)
    monkeypatch.setattr(toxicity, "PER_CLASS", 8)  # a sample so small knows few of the words
    _, docs, labels = told_by_a_rare_word(spark)
    model = toxicity.train(docs, labels)
    texts = [f"two one {word}{i:02d} four" for word in ("vile", "fine") for i in range(40)]
    moved = np.concatenate([(t[:-1, 1:] - s[:-1, 1:]).any(1)[b] for t, s, b in zip(
        model.tables[:1], toxicity.Weights.start(np.zeros((toxicity.SIDES, 2, toxicity.BUCKETS)), np.ones(2)).tables,
        toxicity.Words.of(pa.array([" ".join(f"vile{i:02d}" for i in range(40))])).buckets()[:1])])
    assert moved.mean() > 0.9  # the embedding of nearly every word was trained
    assert np.mean((model.scores(toxicity.Words.of(pa.array(texts))) > 0.5) == np.repeat([True, False], 40)) > 0.95
    again = toxicity.train(docs.repartition(7), labels)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables)) and (model.thresholds == again.thresholds).all()


def test_places_of_maxima_in_chunks(monkeypatch):
    rng = np.random.default_rng(4)
    weights = toxicity.Weights.start(rng.integers(0, 9, (toxicity.SIDES, 2, toxicity.BUCKETS)), np.array([9, 9]))
    counts = np.array([0, 3, 40, 1, 17])
    reach = max(toxicity.WIDTHS) - 1
    begin = np.cumsum(counts + reach) - counts - reach
    ids = rng.integers(0, toxicity.BUCKETS, (toxicity.SIDES, int((counts + reach).sum())))
    for b, n in zip(begin, counts):
        ids[:, b + n:b + n + reach] = toxicity.BUCKETS
    whole = weights.picks(ids, begin, counts)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    pieces = weights.picks(ids, begin, counts)
    assert (whole[0] == pieces[0]).all() and whole[1] == pytest.approx(pieces[1], abs=1e-5)


def test_a_text_meets_its_label_in_the_shard_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 2000)
    _, docs, labels = told_by_a_rare_word(spark)
    labels = labels.filter("doc_id % 10 = 0").unionAll(labels.selectExpr("doc_id + 90000", "toxic"))  # most of no document
    found, plain = [], toxicity._weights
    monkeypatch.setattr(toxicity, "_weights", lambda shards, *rest: found.append(shards) or plain(shards, *rest))
    assert toxicity.train(docs.union(docs.limit(200)), labels) is not None
    (shards,) = found
    assert "Join" not in shards._jdf.queryExecution().executedPlan().toString()
    rows = shards.toArrow()
    texts = {d for d, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()) if t is not None}
    want = {d for d in range(10, 1500, 10) if zlib.crc32(str(d).encode()) % 5}
    assert texts < want and len(texts) > 0.6 * len(want)  # no text without a label leaves its place
    for shard in set(rows["shard"].to_pylist()):
        sides, firsts, y = toxicity._shard(rows.filter(pa.array([s == shard for s in rows["shard"].to_pylist()])))
        mine = [d for d, s, t in zip(*(rows[c].to_pylist() for c in ("doc_id", "shard", "text"))) if s == shard and t is not None]
        assert y.tolist() == [int(d % 3 == 0) for d in sorted(set(mine))] and len(firsts) == len(y) + 1 and sides.shape[1] == firsts[-1]
