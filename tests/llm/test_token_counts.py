"""Token counts and character classes against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from purchaseflow.llm import queries, token_counts, unicode_classes

PATH = public_tokenizers.path(queries.BYTE_VOCABULARY)
HARD = ["", "a", " ", "  a", "a  ", "don't  we'll 's''s 'ssun !'s \n's\t'll", "  <|endoftext|>  a", "x<|endoftext|>y",
        "<|endoftext|><|endoftext|> <|endof", "\x1c \x85 \xa0a", "日本語 12345 ½²", "word " * 5000, "ab" * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x250), 0x300, 0x661, 0x1C89, 0x2028, 0x3000, 0x4E00, 0xAC00, 0x10D50, 0x1F600]]
    pieces = [*letters, " ", " ", "  ", "\n", "'", "'s", "'ll", "'re", "'ve", "'t", "<|endoftext|>", "ab"]
    return HARD + ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(1500)]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_counts_are_the_librarys(library, monkeypatch, piece):
    monkeypatch.setattr(token_counts, "PIECE", piece)
    counter, some = token_counts.TokenCounter(PATH), texts()
    n_bytes, n_tokens = counter.count(pa.array(some), None)
    assert n_tokens.tolist() == [len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(t.encode()) for t in some]


def test_a_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "SLOTS", 64)
    counter, some = token_counts.TokenCounter(PATH), texts()
    for _ in range(2):
        assert counter.count(pa.array(some), None)[1].tolist() == [
            len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)]


def test_every_code_point_has_the_librarys_class():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    table = unicode_classes.class_table()
    for pattern, kind in ((r"\p{L}+", unicode_classes.LETTER), (r"\p{N}+", unicode_classes.NUMBER), (r"\s+", unicode_classes.SPACE)):
        found = set()
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            found.update(points[a:b])
        assert found == {c for a, b in unicode_classes.ranges(kind) for c in range(a, b + 1)}


def test_query_counts_all_rows(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, sf_small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or "", add_special_tokens=False).ids)
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (
            len((d.text or "").encode()), n, n > 512)


def test_nulls_repeats_empty_tables_and_other_columns(spark, library):
    rows = [(1, None, "x", 1), (2, "", "x", 2), (3, "two words", None, 3), (3, "two words", "y", 4), (None, "five", "z", 5),
            (4, "long text " * 100_000, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string, key int")
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.filter(F.lit(False)), PATH).collect() == []
    assert token_counts.count_tokens(docs.filter("text = ''"), PATH).collect() == [(2, 0, 0)]


def test_the_frequent_come_from_all_documents(spark, library, monkeypatch):
    """op13 (F2): long texts and all rows count for the broadcast table; it holds no more than it may."""
    monkeypatch.setattr(token_counts, "FREQUENT", 3)
    monkeypatch.setattr(token_counts, "HELD", 64)
    rng = random.Random(7)
    rows = [(0, " zebra" * 20_000)] + [(i, f" often often {rng.random()}") for i in range(1, 6000)] + [(6000, None), (6001, "<|endoftext|>" * 9000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    table = token_counts.frequent_lengths(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), PATH)
    pieces = [" zebra", " often"]

    def known(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        return table.find(token_counts.word_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)])))[0]
    assert table.used <= 3 and [known(p) for p in pieces] == [len(library.encode(p).ids) for p in pieces]
    assert known("<|endoftext|>") == -1
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH).collect()}
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
