"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word (letters and digits, ASCII case folded) is the sum of hashed embeddings of
the word and of its first four to seven bytes, so unseen forms of a stem are known.  Filters over one, two and three consecutive words are followed by a rectifier and a
maximum over the whole text, so one word or phrase anywhere in a long text counts as much
as in a short one.  Scores are centred on a threshold for each language, guessed from the
text's own function words: 0.5 is the language's threshold.

Every labelled document outside the held-out fold takes part, whole.  A hash of the id makes
a quarter of them the tuning fold, which no weight has seen; the others are dealt to shards
of about ``SHARD`` bytes of text.  A text moves to its shard, where it meets its label, and
by no other shuffle; a table of bits of fixed size keeps nearly all texts without a label
from moving.

* Counts: each shard counts the documents of each class that hold a bucket; the sums over all
  shards give the log-odds that the embeddings start from.
* Weights: each shard trains from that common start over its documents, one task a shard.
  The weights are averaged: a bucket's embeddings by the documents that hold it, the filters
  by documents.  One shard is plain training.
* Thresholds: the logits of all documents of the tuning fold, counted in ``BINS`` steps for
  each language and class; the cut with the fewest errors lies between two steps.

What is summed has a fixed size and is dealt in blocks of ``ROWS`` buckets; the driver holds
the weights only, which are broadcast.  Scoring is one pass without a shuffle.

Defined results: a null, empty or wordless text scores as the bare bias of the model (its
pooled features are zero); rows with a null id take no part; repeated rows are each
scored and count once in training (the largest text); without labels of both classes every
score is 0; an empty table gives no rows.  A text of any length is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (batch, discard, documents, give_back, held_out, known_labels, labelled_sample, long_column, marked,
                     may_be_marked, ready, staged, text_bytes, trim)
from .words import letter_breaks, mix, word_hashes, word_spans

SHARD = 1 << 25  # bytes of labelled text, about
FOLDS = 4  # one of them sets the thresholds
ROWS = 4096
BINS = 4096
PER_CLASS = 3000  # of a sample
SAMPLE_WORDS = 2_500_000  # of the whole sample, half of them for each class
FEWEST = 100  # a document over such a share of its class's words waits for the others
BUCKETS = 1 << 15
SIZE = 12
WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6, 7)
SIDES = 1 + len(STEMS)
FILTERS = 8
EPOCHS = 6
BATCH = 64
RATE = 0.15
CUTOFF = 0.5
FEW = 20  # so many examples of the rarer class weigh as much as the common threshold
CHUNK = 1 << 17

# Some frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in that was for is with on by be at from this",
    "fr": "le la les des et une que dans pour est qui du pas sur au avec",
    "de": "der die das und den von zu mit ist ein eine nicht auf dem des im",
    "es": "el los las que por con una para del es en se su al lo como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")  # no column of the table is read for it
_BREAKS = letter_breaks()


_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A"):ord("Z") + 1] += np.uint64(32)


@dataclass
class Words:
    """The words of some texts: hash, first seven bytes, and the first word of each text."""

    hashes: np.ndarray
    heads: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        raw, offsets = text_bytes(texts)
        starts, ends, firsts = word_spans(raw, offsets, _BREAKS)
        heads = np.zeros(len(starts), np.uint64)
        for i in range(STEMS[-1]):
            inside = starts + i < ends
            heads[inside] |= _LOWER[raw[(starts + i)[inside]]] << np.uint64(8 * i)
        return cls(word_hashes(raw, starts, ends, lower=True), heads, firsts)

    def pick(self, rows: np.ndarray) -> Words:
        parts = [np.arange(self.firsts[i], self.firsts[i + 1]) for i in rows]
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return Words(self.hashes[at], self.heads[at], np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))

    def buckets(self) -> list[np.ndarray]:
        """Bucket numbers of each word: by the word, and by its first bytes."""
        stems = [mix(self.heads & np.uint64((1 << 8 * n) - 1) ^ np.uint64(n << 60)) for n in STEMS]
        return [(x & np.uint64(BUCKETS - 1)).astype(np.int32) for x in (self.hashes, *stems)]


_FUNCTION = {name: Words.of(pa.array([words])).hashes for name, words in FUNCTION_WORDS.items()}
_FUNCTION_HASHES = np.unique(np.concatenate(list(_FUNCTION.values())))
_FUNCTION_OF = np.stack([np.isin(_FUNCTION_HASHES, h) for h in _FUNCTION.values()], 1).astype(np.int64)


def languages(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The index in ``LANGUAGES`` of each text: the most function words, else other."""
    at = np.searchsorted(_FUNCTION_HASHES, hashes)
    at[at == len(_FUNCTION_HASHES)] = 0
    hit = np.flatnonzero(_FUNCTION_HASHES[at] == hashes)
    row = np.searchsorted(firsts, hit, "right") - 1
    counts = np.zeros((len(firsts) - 1, len(FUNCTION_WORDS)), np.int64)
    np.add.at(counts, row, _FUNCTION_OF[at[hit]])
    return np.where(counts.sum(1) > 0, counts.argmax(1), len(FUNCTION_WORDS)) if len(counts) else np.zeros(0, np.int64)


@dataclass
class Model:
    """``tables``: for each of the hashes of a word the embeddings of the buckets; the last
    row is padding.  ``places``: what an embedding adds to every filter at every place of
    its window, one column each."""

    tables: list[np.ndarray]
    places: np.ndarray
    biases: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: np.ndarray
    scale: float

    def pooled(self, words: Words) -> np.ndarray:
        """Maximum of every filter over each text."""
        firsts, sides = words.firsts, words.buckets()
        n_rows = len(firsts) - 1
        best = np.zeros((n_rows, len(WIDTHS) * FILTERS), np.float32)
        n, reach = len(words.hashes), max(WIDTHS) - 1
        row_of = np.searchsorted(firsts, np.arange(0, n, CHUNK), "right") - 1
        for c, lo in enumerate(range(0, n, CHUNK)):
            hi = min(n, lo + CHUNK)
            far = min(n, hi + reach)
            v = self.tables[0][sides[0][lo:far]]
            for table, side in zip(self.tables[1:], sides[1:]):
                v += table[side[lo:far]]
            v = v @ self.places
            if far < hi + reach:
                v = np.concatenate([v, np.zeros((hi + reach - far, v.shape[1]), np.float32)])
            # The first words of later rows: what reaches over them counts as padding.
            a = row_of[c]
            z = int(np.searchsorted(firsts, hi + reach, "left"))
            edges = firsts[a + 1:z] - lo
            edges = edges[(edges > 0)]
            seg = np.unique(np.concatenate([[0], edges[edges < hi - lo]]))
            rows = np.searchsorted(firsts, seg + lo, "right") - 1
            col = 0
            for w, width in enumerate(WIDTHS):
                z_w = v[:hi - lo, col:col + FILTERS].copy()
                col += FILTERS
                for k in range(1, width):
                    part = v[k:k + hi - lo, col:col + FILTERS].copy()
                    for back in range(1, k + 1):
                        at = edges - back
                        part[at[(at >= 0) & (at < hi - lo)]] = 0
                    z_w += part
                    col += FILTERS
                z_w += self.biases[w]
                top = np.maximum.reduceat(z_w, seg, axis=0)
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                best[rows, cols] = np.maximum(best[rows, cols], top)
        return best

    def scores(self, words: Words) -> np.ndarray:
        logits = self.pooled(words) @ self.out + self.bias
        centred = logits - self.thresholds[languages(words.hashes, words.firsts)]
        return 1 / (1 + np.exp(-np.clip(self.scale * centred, -60, 60)))


@dataclass
class Weights:
    """What training moves: the tables of embeddings, the filters and what reads their pools."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, seen: np.ndarray, n_docs: np.ndarray) -> Weights:
        """The common start: the first coordinate of a bucket is the log-odds of a text holding
        it.  ``seen``: side, class and bucket; ``n_docs``: documents of each class."""
        rng = np.random.default_rng(11)
        tables = []
        for side in range(SIDES):
            share = (seen[side] + 0.05) / (n_docs[:, None] + 1.0)
            odds = np.clip(np.log(share[1] / share[0]), -3, 3)
            rare = seen[side].sum(0) < 2
            odds[rare] = np.minimum(odds[rare], 0)
            e = rng.normal(0, 0.02, (BUCKETS + 1, SIZE)).astype(np.float32)
            e[:-1, 0] = odds / 4
            e[-1] = 0
            tables.append(e)
        filters = [rng.normal(0, 0.15, (width, SIZE, FILTERS)).astype(np.float32) for width in WIDTHS]
        for f in filters:
            f[0, 0, :] = np.abs(f[0, 0, :]) + 0.5
        return cls(tables, filters, np.zeros((len(WIDTHS), FILTERS), np.float32),
                   np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), np.full(1, -1, np.float32))

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, self.biases, self.out, self.bias]

    def places(self) -> np.ndarray:
        return np.concatenate([f[k] for f in self.filters for k in range(len(f))], 1)

    def picks(self, ids: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text and filter the place of the maximum in ``ids`` (side by place), and the
        maximum.  ``CHUNK`` places are laid out at a time, so a text may have any length."""
        n, reach, places = ids.shape[1], max(WIDTHS) - 1, self.places()
        ends = begin + np.maximum(counts, 1)
        best = np.full((len(begin), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            v = sum(t[i] for t, i in zip(self.tables, ids[:, lo:min(n, hi + reach)]))
            v = np.concatenate([v, np.zeros((hi + reach - lo - len(v), SIZE), np.float32)])
            v = places.T @ np.ascontiguousarray(v.T)
            z = np.empty((best.shape[1], hi - lo), np.float32)
            row = 0
            for w, width in enumerate(WIDTHS):
                mine = z[w * FILTERS:(w + 1) * FILTERS]
                mine[:] = self.biases[w][:, None]
                for k in range(width):
                    mine += v[row:row + FILTERS, k:k + hi - lo]
                    row += FILTERS
            for d in np.flatnonzero((begin < hi) & (ends > lo)):
                a, b = max(begin[d], lo), min(ends[d], hi)
                at = z[:, a - lo:b - lo].argmax(1)
                top = z[np.arange(len(z)), at + a - lo]
                more = top > best[d]
                best[d][more], where[d][more] = top[more], at[more] + a
        return where, best


def _train(weights: Weights, sides: np.ndarray, firsts: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> None:
    """Adagrad over whole documents, which are given by the buckets of their words (``sides``:
    side by word) and count by the ``weight`` of their class."""
    rng = np.random.default_rng([11, seed])
    tables, filters, biases, out, bias = weights.tables, weights.filters, weights.biases, weights.out, weights.bias
    named = {"out": out, "biases": biases, "bias": bias, **{f"f{i}": f for i, f in enumerate(filters)}}
    memory = {k: np.full_like(v, 1e-3) for k, v in [*named.items(), *[(f"t{i}", t) for i, t in enumerate(tables)]]}

    def step(name: str, grad: np.ndarray) -> None:
        memory[name] += grad * grad
        named[name] -= RATE * grad / np.sqrt(memory[name])

    reach = max(WIDTHS) - 1
    pad = np.full((SIDES, reach), BUCKETS, sides.dtype)
    for epoch in range(EPOCHS):
        shuffled = rng.permutation(len(y))
        for at in range(0, len(shuffled), BATCH):
            some = shuffled[at:at + BATCH]
            ids = np.concatenate([x for i in some for x in (sides[:, firsts[i]:firsts[i + 1]], pad)], 1)
            counts = firsts[some + 1] - firsts[some]
            begin = np.cumsum(counts + reach) - counts - reach
            picks, raw = weights.picks(ids, begin, counts)
            pooled = np.maximum(raw, 0)
            logits = pooled @ out + bias[0]
            wrong = ((1 / (1 + np.exp(-logits)) - y[some]) * weight[y[some]] / len(some)).astype(np.float32)
            back = wrong[:, None] * out * (raw > 0)
            step("out", wrong @ pooled)
            step("bias", wrong.sum(keepdims=True))
            touched, grads = [], []
            bias_grad = np.zeros_like(biases)
            for w, f in enumerate(filters):
                g = back[:, w * FILTERS:(w + 1) * FILTERS]
                gf = np.empty_like(f)
                for k in range(WIDTHS[w]):
                    at_k = np.minimum(picks[:, w * FILTERS:(w + 1) * FILTERS] + k, ids.shape[1] - 1)
                    v = sum(t[ids[side][at_k]] for side, t in enumerate(tables))
                    gf[k] = np.einsum("df,dfe->ef", g, v)
                    touched.append(at_k.ravel())
                    grads.append((g[:, :, None] * f[k].T[None]).reshape(-1, SIZE))
                step(f"f{w}", gf)
                bias_grad[w] = g.sum(0)
            step("biases", bias_grad)
            where, grad = np.concatenate(touched), np.concatenate(grads)
            for side in range(SIDES):
                bucket, inverse = np.unique(ids[side][where], return_inverse=True)
                total = np.zeros((len(bucket), SIZE), np.float32)
                np.add.at(total, inverse, grad)
                memory[f"t{side}"][bucket] += total * total
                tables[side][bucket] -= RATE * 0.5 * total / np.sqrt(memory[f"t{side}"][bucket])
                tables[side][BUCKETS] = 0


def _threshold(low: np.ndarray, high: np.ndarray, counts: np.ndarray, default: float, spread: float) -> float:
    """The cut with the fewest errors, a clean text weighing three toxic ones: the middle
    of the best cuts, drawn to the default by as much as examples are few.  Texts come in
    ascending steps of logits from ``low`` to ``high``, with the ``counts`` of each class."""
    if len(low) == 0:
        return default
    cuts = np.concatenate([[low[0] - spread], (low[1:] + high[:-1]) / 2, [high[-1] + spread]])
    below = np.concatenate([np.zeros((1, 2)), np.cumsum(counts, 0)])
    clean, toxic = counts.sum(0)
    missed = below[:, 1] / max(toxic, 1)
    wrongly = (clean - below[:, 0]) / max(clean, 1)
    cost = missed + 3 * wrongly
    best = cuts[cost <= cost.min() + 1e-12]
    trust = min(toxic, clean) / (min(toxic, clean) + FEW)
    return float(trust * (best[0] + best[-1]) / 2 + (1 - trust) * default)


def _fitting(sizes: np.ndarray, budget: int) -> np.ndarray:
    """Which documents of a class, in the order of the hash, its words have room for."""
    taken = np.zeros(len(sizes), bool)
    long = sizes * FEWEST > budget
    by_size = np.argsort(sizes, kind="stable")
    left = budget
    for i in [*np.flatnonzero(~long), *by_size[long[by_size]]]:
        if sizes[i] <= left:
            taken[i] = True
            left -= int(sizes[i])
    if not taken.any():
        taken[by_size[:1]] = True
    return taken


def within_words(y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which documents the sample keeps: see :func:`training_sample`."""
    taken = np.zeros(len(y), bool)
    for c in (0, 1):
        free = SAMPLE_WORDS - int(sizes[y != c].sum())
        taken[y == c] = _fitting(sizes[y == c], max(SAMPLE_WORDS // 2, free))
    return taken


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``doc_id``, ``y`` and the hashes of the ``words`` of a bounded sample of the labelled
    documents, for a look at what is trained on (:func:`train` reads them all): the first
    ``PER_CLASS`` of each class by a hash of the id, of ``SAMPLE_WORDS`` words in all.  Half of
    the words are each class's own, and what one class leaves free the other may use.
    Documents are taken whole in the hash's order; one that is longer than what is left is
    passed over and the next is tried.  Those over a ``FEWEST``-th of their class's words come
    last, shortest first, so no long text keeps the others out.  A class whose documents are
    all over its words keeps the shortest."""
    ready(docs.sparkSession)

    def hashed(batches):
        for rows in batches:
            words = Words.of(rows.column(1))
            both = np.stack([words.hashes, words.heads], 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2),
                 pa.array([both[a:b].tobytes() for a, b in zip(words.firsts, words.firsts[1:])], pa.binary())],
                names=["doc_id", "y", "words"])

    some = labelled_sample(docs, labels, label, PER_CLASS).mapInArrow(hashed, "doc_id long, y int, words binary")
    # A repeated document counts once.
    sample = staged(some.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("words").alias("words")), "toxicity-sample")
    # At most 2 * PER_CLASS rows of three numbers.
    sizes = (sample.select("doc_id", "y", (F.octet_length("words") / 16).cast("long").alias("n"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    taken = within_words(np.array([r.y for r in sizes], np.int64), np.array([r.n for r in sizes], np.int64))
    ids = docs.sparkSession.createDataFrame([(r.doc_id,) for r, t in zip(sizes, taken) if t], "doc_id long")
    return sample.join(F.broadcast(ids), "doc_id").select("doc_id", "y", "words")


def _tuning() -> Column:
    return F.pmod(F.xxhash64(F.lit("tune"), "doc_id"), F.lit(FOLDS)) == 0


def _shard(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (side by word), first words and classes of a shard's labelled documents, by
    their id; a repeated document counts once."""
    # A label, whose text is null, stands before its document's texts, the largest of them first.
    order = pc.sort_indices(rows.select(["doc_id", "text"]), null_placement="at_start",
                            sort_keys=[("doc_id", "ascending"), ("text", "descending")]).to_numpy()
    ids, label = long_column(rows.column("doc_id"))[order], rows.column("text").is_null().to_numpy()[order]
    at = np.flatnonzero(label[:-1] & ~label[1:] & (ids[:-1] == ids[1:]))
    y = long_column(rows.column("y").take(order[at]))
    rows = rows.select(["text"]).take(order[at + 1])
    parts, counts = [np.zeros((SIDES, 0), np.uint16)], [np.zeros(1, np.int64)]
    for i in range(0, rows.num_rows, 256):
        words = Words.of(rows.column("text").slice(i, 256).combine_chunks())
        parts.append(np.stack(words.buckets()).astype(np.uint16))  # the padding's number fits too
        counts.append(np.diff(words.firsts))
    return np.concatenate(parts, 1), np.cumsum(np.concatenate(counts)), y


def _held(sides: np.ndarray, firsts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many documents of each class hold a bucket: side, class and bucket."""
    seen = np.zeros((SIDES, 2, BUCKETS), np.int64)
    for i, c in enumerate(y):
        for side in range(SIDES):
            seen[side, c, np.unique(sides[side, firsts[i]:firsts[i + 1]])] += 1
    return seen


def _summed(blocks: DataFrame) -> dict[int, np.ndarray]:
    """The sums over all shards of each part's ``blob`` of doubles, whose number is fixed."""
    def run(batches):
        part, total = None, None
        for rows in batches:
            for p, blob in zip(rows.column(0).to_pylist(), rows.column(1)):
                mine = np.frombuffer(blob.as_buffer(), np.float64)
                if p == part:
                    total += mine
                    continue
                if part is not None:
                    yield batch(part=pa.array([part], pa.int32()), blob=pa.array([total.tobytes()], pa.binary()))
                part, total = p, mine.copy()
        if part is not None:
            yield batch(part=pa.array([part], pa.int32()), blob=pa.array([total.tobytes()], pa.binary()))

    # In the order of the shards, so that the sums are the same in every run.
    found = (blocks.repartition("part").sortWithinPartitions("part", "shard").select("part", "blob")
             .mapInArrow(run, "part int, blob binary").collect())
    sums = {r.part: np.frombuffer(r.blob, np.float64) for r in found}
    give_back(blocks.sparkSession)
    return sums


_BLOCKS = "part int, shard long, blob binary"


def _blocks(shard: int, parts: list[np.ndarray]) -> pa.Table:
    return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "shard": pa.array([shard] * len(parts), pa.int64()),
                     "blob": pa.array([p.astype(np.float64).tobytes() for p in parts], pa.binary())})


def _counts(shards: DataFrame) -> np.ndarray:
    """How many documents of all shards hold a bucket: side, class and bucket."""
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        seen = _held(*_shard(rows)).reshape(-1, ROWS)
        trim()
        return _blocks(key[0].as_py(), list(seen))

    seen = np.zeros((SIDES * 2 * BUCKETS // ROWS, ROWS))
    for part, total in _summed(shards.groupBy("shard").applyInArrow(run, _BLOCKS)).items():
        seen[part] = total
    return seen.reshape(SIDES, 2, BUCKETS)


def _weights(shards: DataFrame, seen: np.ndarray, n_docs: np.ndarray) -> Weights:
    """The mean of the weights that each shard makes of the common start."""
    shared = shards.sparkSession.sparkContext.broadcast(seen.astype(np.int32) if seen.max() < 1 << 31 else seen)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sides, firsts, y = _shard(rows)
        del rows
        trim()
        shard, weights = key[0].as_py(), Weights.start(shared.value, n_docs)
        _train(weights, sides, firsts, y, n_docs.sum() / (2 * np.maximum(n_docs, 1)), shard)
        by = _held(sides, firsts, y).sum(1).reshape(-1, ROWS)  # documents that hold a bucket
        rows_of = np.concatenate([t[:-1] for t in weights.tables]).reshape(len(by), ROWS, SIZE)
        dense = np.concatenate([x.ravel() for x in weights.dense()]).astype(np.float64)
        found = _blocks(shard, [np.concatenate([n, (n[:, None] * r.astype(np.float64)).ravel()]) for n, r in zip(by, rows_of)]
                        + [np.concatenate([[len(y)], len(y) * dense])])
        trim()
        return found

    mean = Weights.start(seen, n_docs)
    n_parts = SIDES * BUCKETS // ROWS
    for part, total in _summed(shards.groupBy("shard").applyInArrow(run, _BLOCKS)).items():
        if part == n_parts:
            dense = total[1:] / total[0]
            for x in mean.dense():
                x[:], dense = dense[:x.size].reshape(x.shape), dense[x.size:]
            continue
        side, at = divmod(part * ROWS, BUCKETS)
        held = total[:ROWS]
        some = held > 0
        mean.tables[side][at:at + ROWS][some] = total[ROWS:].reshape(ROWS, SIZE)[some] / held[some, None]
    shared.unpersist()
    return mean


def _set_thresholds(model: Model, docs: DataFrame, known: DataFrame) -> None:
    """Scale and thresholds by all documents of the tuning fold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for rows in batches:
            words = Words.of(rows.column(1))
            yield batch(doc_id=rows.column(0), logit=(model.pooled(words) @ model.out + model.bias).astype(np.float64),
                        lang=languages(words.hashes, words.firsts).astype(np.int32))

    # Logits meet their labels: no text is shuffled.
    logits = (docs.filter(~held_out() & _tuning()).mapInArrow(run, "doc_id long, logit double, lang int")
              .groupBy("doc_id").agg(F.max(F.struct("logit", "lang")).alias("x")).join(known, "doc_id"))
    logits = staged(logits.select("x.logit", "x.lang", "y"), "toxicity-logits")
    all_of = logits.agg(F.min("logit"), F.max("logit"), F.stddev_pop("logit")).first()
    if all_of[0] is not None:
        spread = all_of[2] or 1.0
        step = (all_of[1] - all_of[0]) / BINS or 1.0
        bins = logits.groupBy("lang", F.floor((F.col("logit") - all_of[0]) / step).alias("bin")).agg(
            F.min("logit"), F.max("logit"), F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).collect()
        found = np.array(sorted((b[1], *b) for b in bins), np.float64)[:, [1, 0, 3, 4, 5, 6]]  # language, bin, lows, highs, counts

        def cut(some: np.ndarray, default: float) -> float:
            starts = np.flatnonzero(np.diff(some[:, 1], prepend=-1))
            if not len(starts):
                return default
            return _threshold(np.minimum.reduceat(some[:, 2], starts), np.maximum.reduceat(some[:, 3], starts),
                              np.add.reduceat(some[:, 4:], starts), default, spread)

        common = cut(found, 0.0)
        model.scale = 4.0 / spread
        model.thresholds = np.array([cut(found[found[:, 0] == i], common) for i in range(len(LANGUAGES))])
    discard(logits)
    shared.unpersist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | None:
    """The model of all labelled documents outside the held-out fold; None without both classes."""
    ready(docs.sparkSession)
    known, docs = known_labels(labels, label), documents(docs)
    sizes = docs.filter(~held_out()).groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n")).join(known, "doc_id")
    # At most four rows.
    folds = sizes.groupBy("y", _tuning().alias("tuning")).agg(F.count("*").alias("docs"), F.sum("n").alias("n")).collect()
    if len({r.y for r in folds}) < 2:
        return None
    n_docs = np.array([sum(r.docs for r in folds if r.y == c and not r.tuning) for c in (0, 1)], np.int64)
    n_shards = 1 + sum(r.n for r in folds if not r.tuning) // SHARD
    ids = docs.sparkSession.sparkContext.broadcast(marked(known.select(F.xxhash64("doc_id").alias("h")), "h"))

    @F.arrow_udf("boolean")
    def may_be_known(h: pa.Array) -> pa.Array:
        return pa.array(may_be_marked(ids.value, h.to_numpy(zero_copy_only=False).view(np.uint64)))

    # Texts without a label mostly stay where they are; the rest meet their labels in the shard.
    some = docs.filter(~held_out() & ~_tuning()).filter(may_be_known(F.xxhash64("doc_id")))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(n_shards)).alias("shard")
    shards = some.select(shard, "doc_id", "text", F.lit(None).cast("int").alias("y")).unionByName(
        known.filter(~_tuning()).select(shard, "doc_id", F.lit(None).cast("string").alias("text"), "y"))
    weights = _weights(shards, _counts(shards), n_docs)
    model = Model(weights.tables, weights.places(), weights.biases, weights.out, float(weights.bias[0]),
                  np.zeros(len(LANGUAGES)), 1.0)
    _set_thresholds(model, docs, known)
    ids.unpersist()
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for rows in batches:
            found = model.scores(Words.of(rows.column(1))) if model else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def score_column(spark: SparkSession, model: Model | None, text: Column) -> Column:
    """The score of a text column, for use beside other columns of its rows."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        model = shared.value
        # Some texts at a time: a word takes some 60 bytes of arrays.
        found = (np.concatenate([model.scores(Words.of(texts.slice(i, 256))) for i in range(0, len(texts), 256)])
                 if model and len(texts) else np.zeros(len(texts)))
        return pa.array(found, pa.float64())

    return run(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (score at ``CUTOFF`` or over)."""
    scored = score(docs, train(docs, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
