"""Approximate nearest neighbours over learned partitions.

A bounded sample of the vectors (``FIT``) gives a neighbour graph, which is cut into
balanced parts: recursive median splits, then moves of vertices to the part that holds
most of their neighbours while sizes stay balanced.  A small softmax network learns, from
a vector alone, in which parts its neighbours lie.  It places every vector of the table in
its most probable part, and routes a query to its several most probable parts, as many as
the sample needs for a recall of ``RECALL``, and on to the next ones until they hold enough
other vectors.  Queries and vectors of a part meet in blocks of bounded size and are ranked
by exact inner products in double precision.

The number of parts follows the table (``PART_ROWS`` vectors a part, as far as the sample
can tell parts apart).  Only the model is broadcast.  A part of any size, and a hot vector,
is split in blocks; every block of candidates is a key of its own, to which the blocks of
queries for its part are sent, so no task takes a whole part.  Of equal vectors in a block
no more are kept than a query can return.

Defined results: vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do rows with a null id, nor vectors of another length than most of the
sample; rows that share an id count as one vector, the smallest; ties go to the smaller
id; a query with fewer candidates gets them all; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged

FIT = 8192
PARTS = 32          # of a table of up to PARTS * PART_ROWS vectors, at most
PART_ROWS = 1 << 17
PART_LEAST = 64     # no more parts than leave so many sample vectors in each
NEIGHBOURS = 20
HIDDEN = 96
EPOCHS = 24
RECALL = 0.97
BLOCK = 4096
QUERY_BLOCK = 1024


@dataclass
class Router:
    weights: list[np.ndarray]
    probes: int
    size: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, w3 = self.weights
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.maximum(x @ w1 + b1, 0) @ w2 + x @ w3 + b2

    def routes(self, x: np.ndarray) -> np.ndarray:
        """All parts for each vector, the most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")

    def probed(self, x: np.ndarray, held: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, part) of all parts that each vector is compared in: its ``probes`` most
        probable ones, and the next ones until they hold ``enough`` vectors."""
        routes = self.routes(x)
        before = np.cumsum(held[routes], axis=1) - held[routes]
        chosen = (np.arange(routes.shape[1]) < self.probes) | (before < enough)
        at, place = np.nonzero(chosen)
        return at, routes[at, place]


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, own: bool) -> np.ndarray:
    """Places of the k largest inner products; ``own``: leave out the same place."""
    out = np.empty((len(queries), k), np.int64)
    for i in range(0, len(queries), 512):
        s = queries[i:i + 512] @ vectors.T
        if own:
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i:i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part of nearly equal size for each vertex of a neighbour graph, most edges inside."""
    n = len(x)
    part = np.zeros(n, np.int64)
    groups = [np.arange(n)]
    while len(groups) < parts:
        halves = []
        for g in groups:
            centred = x[g] - x[g].mean(0)
            direction = np.linalg.svd(centred[:: max(1, len(g) // 1024)], full_matrices=False)[2][0]
            order = g[np.argsort(centred @ direction, kind="stable")]
            halves += [order[:len(order) // 2], order[len(order) // 2:]]
        groups = halves
    for i, g in enumerate(groups):
        part[g] = i
    parts = len(groups)
    size = np.bincount(part, minlength=parts)
    least, most = int(0.9 * n / parts), int(np.ceil(1.1 * n / parts))
    both = np.concatenate([graph.ravel(), np.repeat(np.arange(n), graph.shape[1])])
    other = np.concatenate([np.repeat(np.arange(n), graph.shape[1]), graph.ravel()])
    for _ in range(8):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (both, part[other]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            a, b = part[v], best[v]
            if size[b] < most and size[a] > least:
                part[v] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
        if moved < n // 200:
            break
    return part


def fit(x: np.ndarray, n_vectors: int = 0) -> Router:
    """The router of a sample (one vector a row) of a table of ``n_vectors``."""
    rng = np.random.default_rng(3)
    n, size = x.shape
    x = x.astype(np.float64)
    parts = 1
    while 2 * parts <= max(PARTS, n_vectors // PART_ROWS) and n // (2 * parts) >= PART_LEAST:
        parts *= 2
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = HIDDEN ** -0.5
    w = [rng.normal(0, size ** -0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, scale, (HIDDEN, parts)),
         np.zeros(parts), np.zeros((size, parts))]
    if parts == 1:
        return Router(w, 1, size)
    k = min(NEIGHBOURS, n - 1)
    graph = nearest(x, x, k, True)
    part = balanced_parts(unit, graph[:, :10], parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), k), part[graph].ravel()), 1.0 / (k + 2))
    target[np.arange(n), part] += 2.0 / (k + 2)
    held = rng.permutation(n)
    tune, learn = held[:min(1024, n // 5)], held[min(1024, n // 5):]
    first, second = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(learn)
        for i in range(0, len(order), 128):
            some = order[i:i + 128]
            a = unit[some]
            h = np.maximum(a @ w[0] + w[1], 0)
            z = h @ w[2] + a @ w[4] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target[some]) / len(some)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0), a.T @ d)):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                w[j] -= 0.01 * (1 - epoch / EPOCHS) * (first[j] / (1 - 0.9 ** t)) / (np.sqrt(second[j] / (1 - 0.999 ** t)) + 1e-9)
    router = Router(w, parts, size)
    # As many probes as the vectors kept from training need among the whole sample.
    places = router.logits(x).argmax(1)
    routes = router.routes(x[tune])
    where = (routes[:, :, None] == places[graph[tune]][:, None, :]).argmax(1)
    reached = np.bincount(where.ravel(), minlength=parts).cumsum() / where.size
    router.probes = min(parts, int(np.searchsorted(reached, RECALL)) + 1)
    return router


def valid(column: str) -> Column:
    """Whether a vector is there, not zero, and all finite."""
    v = F.col(column)
    return (v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def search(embeddings: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest found of each
    query (the rows for which ``is_query`` holds) among all other rows."""
    spark = embeddings.sparkSession
    ready(spark)
    vectors = staged(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
        .filter(F.col("vec_id").isNotNull() & valid("embedding"))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("asks").alias("asks")), "ann-vectors")
    sample = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).toArrow()
    out = "query_id long, rank int, vec_id long, score double"
    if not sample.num_rows:
        return spark.createDataFrame([], out)
    lengths = np.diff(sample.column("embedding").combine_chunks().offsets.to_numpy())
    size = int(np.bincount(lengths).argmax())
    picked = sample.filter(pa.array(lengths == size)).column("embedding").combine_chunks()
    router = fit(_vectors(picked), vectors.count())
    shared = spark.sparkContext.broadcast(router)

    def place(batches):
        router = shared.value
        for rows in batches:
            if rows.num_rows:
                x = _vectors(rows.column(1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(router.routes(x)[:, 0].astype(np.int32)),
                     pa.array([r.tobytes() for r in x], pa.binary()), rows.column(2)], names=["vec_id", "part", "vector", "asks"])

    placed = staged(vectors.filter(F.size("embedding") == size).mapInArrow(place, "vec_id long, part int, vector binary, asks boolean"), "ann-placed")
    held = np.zeros(len(router.weights[3]), np.int64)
    for row in placed.groupBy("part").count().collect():  # a row a part
        held[row.part] = row["count"]

    def probe(batches):
        router = shared.value
        for rows in batches:
            if rows.num_rows:
                x = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.float64).reshape(-1, size)
                at, part = router.probed(x, held, k + 1)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(at), pa.array(part.astype(np.int32)), rows.column(1).take(at)],
                                                 names=["vec_id", "part", "vector"])

    def packed_blocks(placed: DataFrame, rows_a_block: int, keep: int | None) -> DataFrame:
        """One row a block of a part: its ids, ascending, and its vectors."""
        blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / rows_a_block).alias("blocks"))  # a row a part

        def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").to_numpy()
            rows = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), size)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            if keep:  # of equal vectors, the ones with the smallest ids
                _, twin = np.unique(rows, axis=0, return_inverse=True)
                by_twin = np.argsort(twin.ravel(), kind="stable")
                sizes = np.bincount(twin.ravel())
                nth = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kept = np.sort(by_twin[nth < keep])
                ids, rows = ids[kept], rows[kept]
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                             "rows": pa.array([np.ascontiguousarray(rows).tobytes()], pa.binary())})

        return (placed.join(F.broadcast(blocks), "part")
                .withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
                .select("part", "block", "vec_id", "vector")
                .groupBy("part", "block").applyInArrow(pack, "part int, block int, ids binary, rows binary"))

    candidates = packed_blocks(placed.select("vec_id", "part", "vector"), BLOCK, k + 1).toDF("part", "block", "c_ids", "c_rows")
    queries = packed_blocks(placed.filter("asks").select("vec_id", "vector").mapInArrow(probe, "vec_id long, part int, vector binary"),
                            QUERY_BLOCK, None).select("part", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))

    def rank(batches):
        for rows in batches:
            for qi, qr, ci, cr in zip(*(rows.column(i).to_pylist() for i in range(4))):
                q_ids, c_ids = np.frombuffer(qi, "<i8"), np.frombuffer(ci, "<i8")
                q, c = (np.frombuffer(b, np.float64).reshape(-1, size) for b in (qr, cr))
                found = [[], [], []]
                for i in range(0, len(q), 256):
                    s = q[i:i + 256] @ c.T
                    s[q_ids[i:i + 256, None] == c_ids] = -np.inf
                    n = min(k, len(c_ids))
                    least = np.partition(s, len(c_ids) - n, axis=1)[:, len(c_ids) - n]
                    for j in range(len(s)):
                        # Equal vectors must score alike, so the few near the cut are summed
                        # again in one fixed order.
                        near = np.flatnonzero(s[j] >= least[j] - 1e-9 * max(1.0, abs(least[j]))) if np.isfinite(least[j]) else np.flatnonzero(np.isfinite(s[j]))
                        exact = (c[near] * q[i + j]).sum(1)
                        top = np.lexsort((c_ids[near], -exact))[:k]
                        found[0].append(np.full(len(top), q_ids[i + j]))
                        found[1].append(c_ids[near[top]])
                        found[2].append(exact[top])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["query_id", "vec_id", "score"])

    # Blocks are numbered from 0 in each part: its queries are sent to every one of them.
    blocks = spark.createDataFrame([(i, -(-int(n) // BLOCK)) for i, n in enumerate(held) if n], "part int, blocks int")
    sent = queries.join(F.broadcast(blocks), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "q_ids", "q_rows")
    met = (sent.join(candidates.hint("shuffle_merge"), ["part", "block"])
           .select("q_ids", "q_rows", "c_ids", "c_rows").mapInArrow(rank, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
