"""Document fingerprints: a randomised edit embedding, sampled to bits.

One shared random walk reads every text: at step j the walker stands on a character,
emits it, and a random function of (j, character) decides whether it moves on.  Two texts
walk alike as long as they agree and fall in step again after an edit, so the Hamming
distance of what they emit follows their edit distance.  A fingerprint holds one random
bit of the emitted character at sampled steps.  A step is sampled at a level if its own
hash is under the level's bound; the bound halves with each doubling of the text's
length, so a fingerprint has some 512 to 1,536 bits whatever the length, covers the whole
text, and the finer of two fingerprints can be thinned to the coarser one's steps.

Likeness is the share of equal bits over the steps of the longer walk, rescaled so that
chance agreement (one half) is 0 and equality is 1.

Near-duplicate classes: each class of equal fingerprints enters once, and every pair that can
be alike enough is compared, so no link is lost.  Likeness bounds the lengths: fingerprints
are banded by level and length, and the blocks of a band meet one another and those of the
next band.  Fingerprints also meet at the coarser levels whose texts are near their length.
The time grows with the square of the number of distinct fingerprints of a length; memory
is bounded by a pair of blocks, and a pair of blocks sends one link a member at most.

Defined results: null and empty texts have the fingerprint of no steps, which is like
nothing but itself; rows with a null id take no part; repeated rows and rows that share
an id are each returned, in the order of id and then text; the document after the last is
the first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, long_column, ready, staged
from .components import connected
from .words import mix

LEVEL = 9              # texts under 2 ** LEVEL characters are sampled at every step
STEPS = 3              # a walk takes at most so many steps a character
CHARACTERS = 1 << 24   # characters walked together
BLOCK = 2048           # fingerprints compared with as many others at once
LIKENESS = 0.7
_SEED = np.uint64(0x8F1BBCDCBFA53E0B)


def _draws(a: int, b: int, salt: int) -> np.ndarray:
    """64 random bits for each step from a to b."""
    return mix(np.arange(a, b, dtype=np.uint64) * np.uint64(2) + np.uint64(1) ^ (_SEED * np.array([salt], np.uint64)))


def level_of(n: int) -> int:
    return max(LEVEL, int(n).bit_length())


@cache
def sampled_steps(level: int) -> np.ndarray:
    """The steps sampled at a level, ascending."""
    bound = np.uint64(((1 << 64) - 1) >> (level - LEVEL))
    out = []
    for a in range(0, STEPS << level, 1 << 22):
        steps = np.arange(a, min(STEPS << level, a + (1 << 22)))
        out.append(steps[_draws(int(steps[0]), int(steps[-1]) + 1, 1) <= bound])
    return np.concatenate(out)


def _highest_level(draws: np.ndarray) -> np.ndarray:
    """The coarsest level that still samples a step with this draw."""
    low = np.full(len(draws), LEVEL, np.int64)
    for level in range(LEVEL + 1, 64):
        inside = draws <= np.uint64(((1 << 64) - 1) >> (level - LEVEL))
        if not inside.any():
            break
        low[inside] = level
    return low


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed character codes of the texts, each followed by a rest (0), and lengths."""
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), "<u4")
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = raw * np.uint32(0x9E3779B1)
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x85EBCA77)
    codes ^= codes >> np.uint32(13)
    codes |= np.uint32(1)
    codes[np.cumsum(lengths + 1) - 1] = 0
    return codes, lengths


def walk(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(level, bits) of each text; the texts walk side by side, long ones first."""
    if not texts:
        return []
    codes, lengths = _codes(texts)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths + 1) - lengths - 1)[order]
    sizes = lengths[order]
    at, end = begin.copy(), begin + sizes
    levels = np.array([level_of(n) for n in sizes], np.int64)
    width = max(len(sampled_steps(int(x))) for x in np.unique(levels))
    bits = np.zeros((len(texts), width), np.uint8)
    held = np.zeros(len(texts), np.int64)
    rows = np.arange(len(texts))
    active, step = int(np.count_nonzero(sizes)), 0
    # Where each level's texts begin in the order of falling length.
    first_of = {x: int(np.count_nonzero(levels > x)) for x in range(LEVEL, int(levels.max()) + 1)}
    top = int(levels.max())
    limits = STEPS * sizes
    while active:
        block = 64
        move = (_draws(step, step + block, 2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        emit = (_draws(step, step + block, 3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        reach = np.minimum(_highest_level(_draws(step, step + block, 1)), top)
        for k in range(block):
            here = codes[at[:active]]
            lo = first_of[int(reach[k])]
            if lo < active:
                alive = (at[lo:active] < end[lo:active]) & (step + k < limits[lo:active])
                bit = (here[lo:] * emit[k]) >> np.uint32(31)
                who = rows[lo:active][alive]
                bits[who, held[who]] = bit[alive]
                held[who] += 1
            at[:active] += (here * move[k]) >> np.uint32(31)
        step += block
        done = (at[:active] >= end[:active]) | (step >= limits[:active])
        # Walkers at rest stay where they are; the tail of short texts is let go.
        while active and done[active - 1]:
            active -= 1
    out: list = [None] * len(texts)
    for i, r in enumerate(order):
        out[r] = (int(levels[i]), bits[i, :held[i]].copy())
    return out


def to_text(mark: tuple[int, np.ndarray]) -> str:
    """Level, number of bits and the bits, all hexadecimal."""
    level, bits = mark
    return f"{level:02x}{len(bits):04x}{np.packbits(bits).tobytes().hex()}"


def from_text(text: str) -> tuple[int, np.ndarray]:
    n = int(text[2:6], 16)
    return int(text[:2], 16), np.unpackbits(np.frombuffer(bytes.fromhex(text[6:]), np.uint8))[:n]


def thinned(mark: tuple[int, np.ndarray], level: int) -> np.ndarray:
    """The bits of a fingerprint at the steps of a coarser level."""
    own, bits = mark
    if own == level:
        return bits
    steps = sampled_steps(own)[:len(bits)]
    return bits[np.isin(steps, sampled_steps(level), assume_unique=True)]


def likeness(x: tuple[int, np.ndarray], y: tuple[int, np.ndarray]) -> float:
    level = max(x[0], y[0])
    a, b = thinned(x, level), thinned(y, level)
    n, m = min(len(a), len(b)), max(len(a), len(b))
    if m == 0:
        return 1.0 if len(x[1]) == len(y[1]) == 0 else 0.0
    return max(0.0, 2 * int(np.count_nonzero(a[:n] == b[:n])) / m - 1)


def walked(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """:func:`walk` over pieces of bounded size; equal texts walk once."""
    distinct = sorted(set(texts), key=len)
    marks, some, size = {}, [], 0
    for t in distinct:
        if some and size + len(t) > CHARACTERS:
            marks.update(zip(some, walk(some)))
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    marks.update(zip(some, walk(some)))
    return [marks[t] for t in texts]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every whole text."""
    ready(docs.sparkSession)

    def run(batches):
        for rows in batches:
            texts = rows.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([to_text(m) for m in walked(texts)], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """``bucket``, ``copy``, ``doc_id`` and ``text``, sorted within partitions, such that
    the row after a document (``copy`` 0) holds the next one: buckets are ranges of ids,
    and each ends with a copy of the first document of the next."""
    spark = docs.sparkSession
    parts = ready(spark)
    docs = documents(docs)
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(float(s)) for s in shares]), 100 * parts).alias("b")).first().b if shares else []
    edges = np.unique(np.array(bounds or [], np.int64))

    @F.arrow_udf("int")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, long_column(ids), "right").astype(np.int32))

    firsts = sorted((r.bucket, r.doc_id) for r in docs.select("doc_id").withColumn("bucket", bucket("doc_id"))
                    .groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).collect())  # a row a bucket
    ends = [(int(after[1]), own[0]) for own, after in zip(firsts, [*firsts[1:], *firsts[:1]])]
    where = spark.createDataFrame(ends, "doc_id long, bucket int")
    copies = docs.join(F.broadcast(where), "doc_id").select("bucket", F.lit(1).alias("copy"), "doc_id", "text")
    own = docs.select(bucket("doc_id").alias("bucket"), F.lit(0).alias("copy"), "doc_id", "text")
    return (own.unionAll(copies).repartitionById(parts, F.col("bucket"))
            .sortWithinPartitions("bucket", "copy", "doc_id", "text"))


def with_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document and of its edited text (its last quarter replaced
    by the beginning of the next document), and how like they are to one another and to
    the next document's."""
    ordered = in_order(docs)

    def run(batches):
        held: list[tuple[int, int, str]] = []  # the row before, then the rows of this piece
        size = 0
        for rows in batches:
            for row in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                held.append(row)
                size += len(row[2])
                if size > CHARACTERS // 2:
                    yield from some(held)
                    held, size = held[-1:], len(row[2])
        yield from some(held)

    def some(rows):
        rows, after = rows[:-1], rows[1:]
        pairs = [(d, t, nxt) for (copy, d, t), (_, _, nxt) in zip(rows, after) if not copy]
        if not pairs:
            return
        edited = [t[:len(t) - len(t) // 4] + nxt[:len(t) // 4] for _, t, nxt in pairs]
        n = len(pairs)
        marks = walked([t for _, t, _ in pairs] + edited + [nxt for _, _, nxt in pairs])
        own, changed, following = marks[:n], marks[n:2 * n], marks[2 * n:]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _, _ in pairs], pa.int64()), pa.array([len(t) for _, t, _ in pairs], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array(list(map(to_text, own)), pa.string()), pa.array(list(map(to_text, changed)), pa.string()),
             pa.array(list(map(likeness, own, changed)), pa.float64()),
             pa.array(list(map(likeness, own, following)), pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")


def meeting(mark: tuple[int, np.ndarray], share: float) -> list[tuple[int, np.ndarray]]:
    """The fingerprint at its own level and at each coarser one where it holds a ``share``
    of the steps that the shortest text of that level has at least."""
    own, bits = mark
    steps = sampled_steps(own)
    draws = _drawn(own)
    out = [(own, bits)] if len(bits) else []
    for level in range(own + 1, own + 4):  # a walk is at most STEPS times its text
        inside = draws <= np.uint64(((1 << 64) - 1) >> (level - LEVEL))
        kept = bits[inside[:len(bits)]]
        if len(kept) and len(kept) >= share * np.count_nonzero(inside & (steps < 1 << level - 1)):
            out.append((level, kept))
    return out


@cache
def _drawn(level: int) -> np.ndarray:
    """The draws of the level's sampled steps."""
    steps = sampled_steps(level).astype(np.uint64)
    return mix(steps * np.uint64(2) + np.uint64(1) ^ (_SEED * np.array([1], np.uint64)))


def _signs(marks: list[bytes], sizes: np.ndarray, width: int) -> np.ndarray:
    """Bits as 1 and -1, padded by 0."""
    out = np.zeros((len(marks), width), np.float32)
    for row, blob, n in zip(out, marks, sizes):
        row[:n] = np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(np.float32) * 2 - 1
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number linked to each of ``n`` numbers by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        if (root[a] == low).all() and (root[b] == low).all():
            return root
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]


def _near(rows: pa.Table, least: float) -> pa.Table:
    """Links of a task's fingerprints: those of side 0 with one another if there is no side
    1, else with those of side 1; at least one of a pair is at its own level."""
    side = rows.column("side").to_numpy()
    sizes = rows.column("n").to_numpy().astype(np.int64)
    own = rows.column("own").to_numpy(zero_copy_only=False).astype(bool)
    reps = rows.column("rep").to_numpy()
    marks = rows.column("bits").to_pylist()
    signs = _signs(marks, sizes, int(sizes.max()))
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if rows.column("alone")[0].as_py():
        x = y = np.arange(len(side))
    lefts, rights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(x), 256):
        some = x[at:at + 256]
        twice = np.minimum.outer(sizes[some], sizes[y]) + (signs[some] @ signs[y].T).astype(np.int64)
        near = twice / np.maximum.outer(sizes[some], sizes[y]) - 1 >= least
        near &= np.logical_or.outer(own[some], own[y])
        i, j = np.nonzero(near)
        lefts.append(some[i])
        rights.append(y[j])
    root = _forest(np.concatenate(lefts), np.concatenate(rights), len(side))
    linked = np.flatnonzero(root != np.arange(len(side)))
    return pa.table({"a": pa.array(reps[root[linked]], pa.int64()), "b": pa.array(reps[linked], pa.int64())})


def near_links(classes: DataFrame, least: float) -> DataFrame:
    """Links ``a``-``b`` that join the same ``rep`` as all pairs of fingerprints whose
    likeness is ``least`` (over 0) or more."""
    spark = classes.sparkSession
    # The shorter has as many bits as agree, a share of the longer's; wider bands do no harm.
    share = min((1 + least) / 2, 0.95)

    def placed(batches):
        for rows in batches:
            found = [(level, int(np.log(len(bits)) / -np.log(share * 0.9999)), level == int(text[:2], 16), rep,
                      len(bits), np.packbits(bits).tobytes())
                     for text, rep in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())
                     for level, bits in meeting(from_text(text), share)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(kinds.names, f)) for f in found], schema=kinds)

    kinds = pa.schema([("level", pa.int32()), ("cell", pa.int32()), ("own", pa.bool_()), ("rep", pa.int64()),
                       ("n", pa.int32()), ("bits", pa.binary())])
    rows = staged(classes.select("fingerprint", "rep").mapInArrow(
        placed, "level int, cell int, own boolean, rep long, n int, bits binary"), "bands")
    # One row a level and length band: some hundreds at most.
    counts = {(r.level, r.cell): (r.n, r.own) for r in rows.groupBy("level", "cell").agg(
        F.count("*").alias("n"), F.sum(F.col("own").cast("long")).alias("own")).collect()}
    blocks = {(level, cell): -(-n // BLOCK) for (level, cell), (n, _) in counts.items()
              if any(counts.get((level, c), (0, 0))[1] for c in (cell - 1, cell, cell + 1))}
    sizes = spark.createDataFrame([(*k, n, blocks.get((k[0], k[1] - 1), 0), blocks.get((k[0], k[1] + 1), 0))
                                   for k, n in blocks.items()], "level int, cell int, blocks long, before long, after long")
    dealt = rows.join(F.broadcast(sizes), ["level", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))

    def task(kind: int, cell, i, j, side, alone, others: str) -> DataFrame:
        return (dealt.filter(F.col(others) > 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
                .select("level", cell.alias("cell"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"),
                        side.cast("int").alias("side"), alone.alias("alone"), "own", "rep", "n", "bits"))

    block, other, cell, no = F.col("block"), F.col("other"), F.col("cell"), F.lit(False)
    tasks = (task(0, cell, F.least(block, other), F.greatest(block, other), block > other, block == other, "blocks")
             .unionAll(task(1, cell, block, other, F.lit(0), no, "after"))
             .unionAll(task(1, cell - 1, other, block, F.lit(1), no, "before")))
    return tasks.groupBy("level", "cell", "kind", "i", "j").applyInArrow(lambda rows: _near(rows, least), "a long, b long")


def near_classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``doc_id`` and ``class_id`` (the smallest id linked to it) of every document."""
    marked = staged(fingerprints(docs), "fingerprints")
    classes = staged(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected(near_links(classes, least)).toDF("rep", "root")
    of_class = classes.join(roots, "rep", "left").select("fingerprint", F.coalesce("root", "rep").alias("class_id"))
    return marked.join(of_class, "fingerprint").select("doc_id", "class_id")
