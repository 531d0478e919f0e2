"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text becomes the logarithmic counts of its hashed byte trigrams, weighted by rarity, at
unit length, and a few shares that trigrams miss (repeated words, capitals, marks, digits,
distinct words); all are projected on the leading singular directions of a bounded sample of labelled documents
(``PER_CLASS`` of each class).  The sample's vectors and labels are broadcast: their
number and size are fixed.  Every document's cosine to every labelled vector is computed
exactly, in blocks, and the ``NEIGHBOURS`` nearest vote with a power of their similarity.

Defined results: a null or empty text, and any text without a trigram in the sample, gets
the share of label 1 in the sample; rows with a null id take no part; repeated rows are
each scored; an empty table gives no rows; without labels every score is 0.  Whole texts of
any length are read; the counts of a text have a fixed size.  Of sample vectors whose cosines
tie at the last place of the neighbours, which one votes is numpy's choice: the same for equal
texts, as they have equal cosines.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fitted, held_out, labelled_sample, long_column, ready, text_bytes
from .words import word_hashes, word_spans

PER_CLASS = 2048
FEATURES = 4096
DIMENSIONS = 64
NEIGHBOURS = 24
POWER = 8.0
CUTOFF = 0.3
BLOCK = 512
PIECE = 1 << 22


SHAPES = 5
SHAPE_WEIGHT = 1.0
_KIND = np.zeros((256, 3), np.float32)  # capitals, marks, digits
_KIND[ord("A"):ord("Z") + 1, 0] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()], 1] = 1
_KIND[ord("0"):ord("9") + 1, 2] = 1


def shape_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of each row: words equal to the word before, capitals, marks, digits, and
    words that are not the row's first of their kind (as a logarithmic excess)."""
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES), np.float32)
    starts, ends, firsts = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        h = hashes[firsts[i]:firsts[i + 1]]
        if b > a:
            histogram = np.bincount(raw[a:b], minlength=256)
            out[i, 1:4] = histogram @ _KIND / (b - a)
        if len(h) > 1:
            out[i, 0] = np.mean(h[1:] == h[:-1])
            out[i, 4] = np.log(len(h) / len(np.unique(h))) / np.log(len(h))
    out[:, 1:4] = np.sqrt(out[:, 1:4])
    return out


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts and shape shares, one row per text."""
    a, b = offsets[0], offsets[-1]
    return np.concatenate([trigram_counts(raw, offsets), shape_shares(raw[a:b], offsets - a)], 1)


def trigram_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logarithmic counts of the hashed byte trigrams of each row; a text ends with two
    zero bytes, so one- and two-byte texts have trigrams too."""
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        counts = np.zeros(FEATURES, np.int64)
        for lo in range(a, b, PIECE):
            hi = min(b, lo + PIECE)
            x = np.zeros(hi - lo + 2, np.uint32)
            x[:min(b, hi + 2) - lo] = raw[lo:min(b, hi + 2)]
            code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
            counts += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)
        out[i] = counts
    return np.log1p(out, out=out)


@dataclass
class Model:
    rarity: np.ndarray       # FEATURES
    centre: np.ndarray       # FEATURES + SHAPES
    directions: np.ndarray   # FEATURES + SHAPES x DIMENSIONS
    vectors: np.ndarray      # sample x DIMENSIONS, unit length
    labels: np.ndarray       # sample
    share: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Unit trigram weights and weighted shapes around the sample's mean."""
        x = counts.copy()
        x[:, :FEATURES] *= self.rarity
        norms = np.linalg.norm(x[:, :FEATURES], axis=1, keepdims=True)
        x[:, :FEATURES] /= np.maximum(norms, 1e-9)
        x[:, FEATURES:] *= SHAPE_WEIGHT
        x -= self.centre
        x[norms[:, 0] <= 0] = 0
        return x

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self.weighted(counts) @ self.directions
        norms = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norms, out=np.zeros_like(v), where=norms > 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        v = self.project(counts)
        near = min(NEIGHBOURS, len(self.labels))
        cosines = v @ self.vectors.T
        top = np.argpartition(cosines, -near, axis=1)[:, -near:]
        weights = np.maximum(np.take_along_axis(cosines, top, 1), 0).astype(np.float64) ** POWER
        total = weights.sum(1)
        votes = (weights * self.labels[top]).sum(1)
        return np.clip(np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.share), 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Rarity weights and singular directions of the sample, by subspace iteration."""
    n = len(counts)
    rarity = np.log((1 + n) / (1 + (counts[:, :FEATURES] > 0).sum(0))).astype(np.float32) + 1
    size = min(DIMENSIONS, n)
    model = Model(rarity, np.zeros(FEATURES + SHAPES, np.float32), np.zeros((FEATURES + SHAPES, size), np.float32),
                  np.zeros((0, size), np.float32), labels.astype(np.float64), float(labels.mean()))
    model.centre = model.weighted(counts).mean(0)
    x = model.weighted(counts)
    basis = np.random.default_rng(7).normal(size=(FEATURES + SHAPES, size + 8)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    model.directions = np.ascontiguousarray((basis @ turn.T)[:, :size])
    model.vectors = model.project(counts)
    return model


def _fit(rows: list[pa.RecordBatch]) -> Model | None:
    """The model of all rows of a training sample."""
    ys = np.concatenate([np.zeros(0, np.int64), *[long_column(r.column(1)) for r in rows]])
    if not len(ys):
        return None
    table = np.empty((len(ys), FEATURES + SHAPES), np.float32)
    blobs = (blob for r in rows for blob in r.column(2))
    for i, blob in enumerate(blobs):
        table[i] = np.frombuffer(blob.as_buffer(), np.float16)
    return fit(table, ys)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """The model of a bounded sample of labelled documents; None without any."""
    ready(docs.sparkSession)

    def counted(batches):
        for rows in batches:
            raw, offsets = text_bytes(rows.column(1))
            blobs = []
            for i in range(0, rows.num_rows, BLOCK):
                blobs += [r.astype(np.float16).tobytes() for r in features(raw, offsets[i:i + BLOCK + 1])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(blobs, pa.binary())], names=["doc_id", "y", "counts"])

    some = labelled_sample(docs, labels, label, PER_CLASS).mapInArrow(counted, "doc_id long, y int, counts binary")
    # At most 2 * PER_CLASS rows of 8 KB.
    return fitted(some.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("counts").alias("counts")), [F.xxhash64("doc_id")], _fit)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for rows in batches:
            raw, offsets = text_bytes(rows.column(1))
            for i in range(0, rows.num_rows, BLOCK):
                counts = features(raw, offsets[i:i + BLOCK + 1])
                found = model.scores(counts) if model else np.zeros(len(counts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(i, BLOCK), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def score_column(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """The score of a text column, for use beside other columns of its rows."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model = shared.value
        raw, offsets = text_bytes(texts)
        found = (np.concatenate([model.scores(features(raw, offsets[i:i + BLOCK + 1])) for i in range(0, len(texts), BLOCK)])
                 if model and len(texts) else np.zeros(len(texts)))
        return pa.array(found, pa.float64())

    return run(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score at ``CUTOFF`` or over)."""
    scored = score(docs, train(docs, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
