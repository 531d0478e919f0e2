"""BPE and packing against the tokenizers library and a plain concatenation."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from purchaseflow.llm import bpe, packing, queries
from purchaseflow.llm.token_ids import WordIds

PATH = public_tokenizers.path(queries.VOCABULARY)
HARD = ["", " ", "\n\t", "a <|endoftext|>b<|startoftext|> <|x", "I'LL we've 's ''s", "ΑΣ Σ ΣΑΣ", "İstanbul",
        "é क़ ̀", "x\x1cy \x1f z", "日本語 12345 ½²", "!?'s ...the", " nb sp", "word," * 5000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x330), *range(0x370, 0x400), 0x3000, 0x4e00, 0xac00]]
    return HARD + ["".join(rng.choices([*letters, " ", "'s", "<|endoftext|>"], k=rng.randint(0, 60))) for _ in range(600)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int")


def test_both_encoders_agree_with_the_library(library):
    own, by_piece = bpe.WordBpe(PATH), WordIds(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids, decoded = own.encode(text)
        assert np.frombuffer(ids, "<u2").tolist() == want, text[:60]
        assert decoded == library.decode(want, skip_special_tokens=False)
        assert by_piece.encode(pa.array([text]))[0].tolist() == want, text[:60]


def test_every_code_point_is_encoded_as_the_library_does(library):
    own, by_piece = bpe.WordBpe(PATH), WordIds(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        # a letter and a digit on both sides show the class of each character
        text = " ".join(f"a{chr(c)}b 1{chr(c)}2" for c in points[at:at + 4096])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text)[0], "<u2").tolist() == want, hex(points[at])
        assert by_piece.encode(pa.array([text]))[0].tolist() == want, hex(points[at])


def test_bounded_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    monkeypatch.setattr("purchaseflow.llm.token_ids.SLOTS", 256)
    monkeypatch.setattr("purchaseflow.llm.token_ids.WORDS", 3)
    own, by_piece = bpe.WordBpe(PATH), WordIds(PATH)
    for text in [*texts()[:200], " ".join(f"w{i}" for i in range(2000))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text)[0], "<u2").tolist() == want
        ids, bounds = by_piece.encode(pa.array([text, "x", text]))
        assert ids[bounds[2]:].tolist() == want


def test_case_and_punctuation_make_no_new_pieces(library):
    """op3: new pieces are what a batch costs; a word in three cases with three marks was nine of them."""
    words = ["inor", "thble", "tionhe", "heedth", "andwh"]
    text = " ".join(f"{form}{mark}" for w in words for form in (w, w.capitalize(), w.upper()) for mark in ("", ",", "!!", "'s", "|"))
    by_piece = WordIds(PATH)
    assert by_piece.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    # once per word, ",", "!!", "'s", "'S"; a bar may belong to a special token and stays with its word
    assert len(by_piece.ends) - 1 == len(words) + 3 + 3 * len(words)


def test_pieces_cut_at_punctuation_are_the_librarys(library):
    rng = random.Random(11)
    parts = ["ab", "Q", "7", "İ", "Σ", "é", "e\u0301", "\u0301", "'", "'S", "'ll", "<|endoftext|>", "<|", "|>", "|", "<", "@", "_", "~",
             "\x1c", "\x7f", "`", ";", "\u037e", "...", " ", "\u2028", "\u4e00"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(4000)]
    ids, bounds = WordIds(PATH).encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_query_on_hard_rows(spark, library):
    rows = [(i, t, "x", i) for i, t in enumerate(texts()[:60])] + [(900, None, None, None), (None, "a", "b", 1), (0, "", "x", 0)]
    got = bpe.token_digests(bpe.encode_documents(frame(spark, rows), PATH)).collect()
    assert len(got) == len(rows) - 1
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows if r[0] is not None}
    for r in got:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_pieces(pieces, streams):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(streams)
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(streams[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(streams[doc][at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(streams[doc])
    total = sum(map(len, streams.values()))
    assert sorted(by_sequence) == list(range(-(-total // 4096)))
    for s, parts in by_sequence.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == (4096 if s < max(by_sequence) else total - 4096 * max(by_sequence))


def test_packing_is_a_gapless_cut_of_every_document(spark, library):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "beta,", "Gamma", "x9"], k=rng.choice([0, 3, 800, 9000]))), "c", i)
            for i in range(60)] + [(100, None, None, None), (None, "a", "b", 1)]
    pieces = packing.piece_digests(packing.pack(frame(spark, rows).repartition(5), PATH)).collect()
    check_pieces(pieces, {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2]
                          for r in rows if r[0] is not None})


def test_packing_and_bpe_of_an_empty_table(spark):
    empty = frame(spark, [])
    assert packing.pack(empty, PATH).count() == 0
    assert bpe.encode_documents(empty, PATH).count() == 0


def test_packing_query_whole_table(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    check_pieces(queries.op3_packing(spark, sf_small).collect(),
                 {r.doc_id: library.encode(r.t, add_special_tokens=False).ids + [2] for r in docs})
