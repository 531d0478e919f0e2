"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with equal sets are one class.  Two classes link when
``100 * intersection >= percent * union``; the result is each document's component.

* Light: sets below a boundary size enumerate the subsets of the one size that a linked
  pair of two given sizes must share, so a common subset is a link; the members of a
  subset's list are tied to its smallest member.
* Heavy: sets from the boundary on (and the smaller ones that can link with them) enter
  the inverted lists of their prefix, the part of a set that any linked set must meet.
  Shingles are ordered by their count in the corpus, rarest first, so common passages
  come last.  The lists are scanned in three rounds, and verified pairs join components
  after each.  First every member is paired with the smallest member of its list and size
  class.  The lists that still hold several components are then scanned whole, block by
  block: members of different components are compared inside the task by their cell
  counts.  In the second round each member's most similar partner leaves the task, which
  ties up families of near copies; in the third round all pairs that may still link do,
  and what is left are pairs on the verge of linking.
* The boundary is the size with the least estimated cost: subsets enumerated below it
  against list entries read above it, at the measured mean length of a list.

Pairs are pruned by counts of shingles in 256 hash cells (an upper bound of the
intersection) and then verified on the whole sets.  Words, shingles and sets are told
apart by 64-bit hashes.

Nothing is dropped: the count of the ``HEAVY`` most common shingles, which is broadcast,
and the bit table of candidate sets, which has a fixed size, only order and prune; a list
longer than ``SPLIT`` is dealt over several tasks by salting.

Defined results: a null, empty or wordless text has no shingle and is its own component;
a text with fewer words than a shingle is one shingle of all its words; rows with a null
id take no part; repeated rows are each returned; equal sets share a component; an empty
table gives no rows; the set of a text of any length is its whole set.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, marked, may_be_marked, ready, staged, text_bytes, trim
from .components import connected
from .words import _STEP, mix, runs, word_hashes, word_spans

HEAVY = 1 << 18
HEAVY_FROM = 8
SPLIT = 4096
LARGEST_BOUNDARY = 32
CELLS = 256
CELLED = 30_000     # larger sets are not pruned by their cells, which count to 255
BLOCK = 2048

_ENTRY = np.dtype([("token", "<u8"), ("set", "<u8"), ("n", "<u4"), ("tag", "<u2")])


def overlap(n: int, m: int, percent: int) -> int:
    """The least intersection with which sets of sizes n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n: int, percent: int) -> int:
    """So many first shingles of a set of size n meet those of every set it links with."""
    return n - -(-percent * n // 100) + 1


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_bytes(texts)
    starts, ends, firsts = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True)
    shingles = runs(hashes, words)
    out = []
    for a, b in zip(firsts, firsts[1:]):
        if b - a >= words:
            out.append(np.unique(shingles[a:b - words + 1]))
        elif b > a:
            out.append(runs(hashes[a:b], int(b - a)) ^ mix(np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> np.uint64:
    """One hash of a whole set, whatever the order of its members."""
    size = np.array([len(s)], np.uint64)
    return mix(size * _STEP ^ s.sum(dtype=np.uint64))[0]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _dealt(keys: np.ndarray, parts: int):
    """The places of the entries that go to each part, by the key's remainder."""
    part = (keys % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    found, begin = np.unique(part[order], return_index=True)
    for p, a, b in zip(found, begin, [*begin[1:], len(order)]):
        yield int(p), order[a:b]


def _blobs(parts: list[int], blobs: list[bytes], names=("pid", "blob")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=list(names))


def partners(n: int, below: int, percent: int) -> list[tuple[int, int, int]]:
    """For a set of size n: (smaller size, larger size, shared subset's size) of the pairs
    of sizes under ``below`` in which different sets can link."""
    out = []
    for m in range(1, below):
        a, b = min(n, m), max(n, m)
        shared = overlap(a, b, percent)
        if shared <= a and not (a == b == shared):
            out.append((a, b, shared))
    return out


def subset_entries(s: np.ndarray, own: np.uint64, below: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(key, set, size, tag) of every subset that a small set shares with a linked one.
    A subset's key is the sum of its members, told apart by the pair of sizes; the tag is
    0 for the smaller set of the pair, 1 for the larger, 2 for equal sizes."""
    n, out = len(s), []
    total = int(s.sum(dtype=np.uint64))
    values = [int(x) for x in s]
    for a, b, shared in partners(n, below, percent):
        tag = 2 if a == b else int(n == b)
        for dropped in combinations(values, n - shared):
            out.append((int((total - sum(dropped) + (a << 40) + (b << 20)) % (1 << 64)), int(own), n, tag))
    return out


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int):
        self.spark = docs.sparkSession
        self.parts = 2 * ready(self.spark)
        self.docs, self.words, self.percent = documents(docs), words, percent

    def _pass(self, function, schema: str) -> DataFrame:
        """One pass over all texts; ``function`` gets the sets of a batch."""
        words = self.words

        def run(batches):
            for rows in batches:
                yield from function(rows.column(0), shingle_sets(rows.column(1), words))

        return self.docs.mapInArrow(run, schema)

    def sizes(self) -> DataFrame:
        """``doc_id``, size, set and the cell counts of its set."""
        def run(ids, sets):
            cells = [np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()
                     for s in sets]
            keys = np.array([set_id(s) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(keys)), pa.array(cells, pa.binary())],
                names=["doc_id", "n", "set_id", "cells"])

        return self._pass(run, "doc_id long, n long, set_id long, cells binary")

    def counts(self, least: int) -> DataFrame:
        """How many sets hold each shingle, among twice the prefix of each set."""
        parts, percent = self.parts, self.percent

        def run(ids, sets):
            distinct = {int(set_id(s)): s[:2 * prefix(len(s), percent) + 4] for s in sets if len(s) >= least}
            if not distinct:
                return
            tokens, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            pids, blobs = [], []
            for p, at in _dealt(tokens, parts):
                pids.append(p)
                blobs.append(tokens[at].tobytes() + counts[at].astype("<u2").tobytes())
            yield _blobs(pids, blobs)

        def add(table: pa.Table) -> pa.Table:
            tokens, counts = [], []
            for blob in table.column("blob").to_pylist():
                n = len(blob) // 10
                tokens.append(np.frombuffer(blob, "<u8", n))
                counts.append(np.frombuffer(blob, "<u2", n, 8 * n))
            keys, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            common = total >= HEAVY_FROM
            # The first row sums up the others: entries, and entries weighted by the list's length.
            return pa.table({
                "token": pa.array(np.concatenate([[0], _signed(keys[common])])),
                "held": pa.array(np.concatenate([[-int(total.sum())], total[common]])),
                "weighted": pa.array(np.concatenate([[float((total.astype(float) ** 2).sum())], np.zeros(common.sum())]))})

        return self._pass(run, "pid int, blob binary").groupBy("pid").applyInArrow(add, "token long, held long, weighted double")

    def boundary(self, classes: DataFrame, mean_list: float) -> int:
        """The size with the least estimated cost of subsets below and lists above."""
        percent = self.percent
        sizes = {r.n: r.sets for r in classes.groupBy(F.least("n", F.lit(4 * LARGEST_BOUNDARY)).alias("n"))
                 .agg(F.count("*").alias("sets")).collect()}
        best = (float("inf"), 1)
        for below in range(1, LARGEST_BOUNDARY + 1):
            light = sum(sizes.get(n, 0) * sum(comb(n, s) for _, _, s in partners(n, below, percent)) for n in range(1, below))
            from_size = -(-percent * below // 100)
            heavy = sum(c * prefix(n, percent) * mean_list for n, c in sizes.items() if n >= from_size)
            best = min(best, (light + heavy, below))
        return best[1]

    def lists(self, heavy: tuple[np.ndarray, np.ndarray], below: int) -> DataFrame:
        """The inverted lists with two sets or more: ``token``, ``set_id``, ``n`` and the
        ``hub`` it is first paired with.  Subset lists have no token: their pairs are
        complete."""
        parts, percent = self.parts, self.percent
        from_size = -(-percent * below // 100)
        shared = self.spark.sparkContext.broadcast(heavy)

        def run(ids, sets):
            common, held = shared.value
            distinct = {int(set_id(s)): s for s in sets if len(s)}
            entries, subsets = [], []
            for own, s in distinct.items():
                n = len(s)
                if n < below:
                    subsets += subset_entries(s, np.uint64(own), below, percent)
                if n < from_size:
                    continue
                p = prefix(n, percent)
                at = np.searchsorted(common, s) if len(common) else np.zeros(n, np.int64)
                at[at == len(common)] = 0
                known = common[at] == s if len(common) else np.zeros(n, bool)
                rare = s[~known]
                tag = np.zeros(p, np.uint16)
                if len(rare) >= p:
                    first = rare[:p]
                else:
                    rest, count = s[known], held[at[known]]
                    order = np.lexsort((rest, count))[:p - len(rare)]
                    first = np.concatenate([rare, rest[order]])
                    splits = -(-count[order] // SPLIT)
                    tag[len(rare):] = np.minimum(np.uint64(own) % splits.astype(np.uint64), 0xFFFF)
                e = np.empty(p, _ENTRY)
                e["token"], e["set"], e["n"], e["tag"] = first, own, n, tag
                entries.append(e)
            pids, blobs = [], []
            if entries:
                e = np.concatenate(entries)
                for q, at in _dealt(e["token"] + e["tag"] * _STEP, parts):
                    pids.append(q)
                    blobs.append(e[at].tobytes())
            if subsets:
                e = np.array(subsets, _ENTRY)
                for q, at in _dealt(e["token"], parts):
                    pids.append(parts + q)
                    blobs.append(e[at].tobytes())
            for i in range(0, len(pids), 1024):
                yield _blobs(pids[i:i + 1024], blobs[i:i + 1024])

        ratio = np.log(100 / percent) if percent < 100 else 1.0

        def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            trim()
            e = np.concatenate([np.frombuffer(b, _ENTRY) for b in table.column("blob").to_pylist()])
            small = key[0].as_py() >= parts
            sizes = np.zeros(len(e), np.int64) if small else np.floor(np.log(np.maximum(e["n"], 1)) / ratio).astype(np.int64)
            salt = np.zeros(len(e), np.uint16) if small else e["tag"]
            order = np.lexsort((e["set"], e["tag"], sizes, salt, e["token"]))
            e, sizes, salt = e[order], sizes[order], salt[order]
            if len(e) > 1:  # copies of a set in different batches
                new = np.ones(len(e), bool)
                new[1:] = (e["token"][1:] != e["token"][:-1]) | (e["set"][1:] != e["set"][:-1]) | (e["tag"][1:] != e["tag"][:-1])
                e, sizes, salt = e[new], sizes[new], salt[new]
            if small:
                return _subset_pairs(e)
            token_starts = np.flatnonzero(np.concatenate([[True], (e["token"][1:] != e["token"][:-1]) | (salt[1:] != salt[:-1])]))
            lengths = np.diff(np.append(token_starts, len(e)))
            # A split list may have its other members elsewhere, so none of it is dropped.
            keep = (np.repeat(lengths, lengths) > 1) | (salt > 0) | np.isin(e["token"], shared_split())
            e, sizes, salt = e[keep], sizes[keep], salt[keep]
            if not len(e):
                return _pairs_table(e["token"], e["set"], e["n"], e["set"])
            starts = np.flatnonzero(np.concatenate(
                [[True], (e["token"][1:] != e["token"][:-1]) | (salt[1:] != salt[:-1]) | (sizes[1:] != sizes[:-1])]))
            hub = np.repeat(e["set"][starts], np.diff(np.append(starts, len(e))))
            return _pairs_table(e["token"], e["set"], e["n"], hub)

        def shared_split():
            common, held = shared.value
            return common[held > SPLIT]

        return (self._pass(run, "pid int, blob binary").groupBy("pid")
                .applyInArrow(gather, "token long, set_id long, n long, hub long"))

    def pruned(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The ``a``-``b`` pairs that may link by their sizes and cells."""
        percent = self.percent
        cells = classes.select("set_id", "n", "cells")
        near = (pairs.join(cells.toDF("a", "n_a", "cells_a"), "a").join(cells.toDF("b", "n_b", "cells_b"), "b")
                .filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))

        def prune(batches):
            for rows in batches:
                if not rows.num_rows:
                    continue
                x, y = (_cells(rows.column(i)) for i in (4, 5))
                keep = pa.array(may_link(rows.column(2).to_numpy(), rows.column(3).to_numpy(), np.minimum(x, y).sum(1, dtype=np.int64), percent))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

        return near.select("a", "b", "n_a", "n_b", "cells_a", "cells_b").mapInArrow(prune, "a long, b long")

    def verified(self, near: DataFrame) -> DataFrame:
        """The ``a``-``b`` pairs of a staged table that link, by their whole sets."""
        percent = self.percent
        sets = staged(self._sets(near), "jaccard-sets")

        def compare(batches):
            for rows in batches:
                keep = []
                for x, y in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

        links = staged(near.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a")
                       .select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"), "jaccard-links")
        discard(sets)
        return links

    def scanned(self, lists: DataFrame, roots: DataFrame, classes: DataFrame, nearest: bool) -> DataFrame:
        """The pairs of a list in different components that may link; with ``nearest``, of
        each member the most similar one.  Of lists with the same members one is scanned; a
        list of many members is dealt as pairs of blocks."""
        held = (lists.filter("token IS NOT NULL").select("token", "set_id", "n")
                .join(roots.toDF("set_id", "root"), "set_id", "left")
                .select("token", "set_id", "n", F.coalesce("root", "set_id").alias("root")))
        apart = held.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        held = held.join(apart.select("token"), "token", "left_semi")
        percent = self.percent
        scans = held.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("members"))
        scans = scans.groupBy("m", "members").agg(F.min("token").alias("token")).select(
            "token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        dealt = (held.join(scans, "token").join(classes.select("set_id", "cells"), "set_id")
                 .withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks").cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         "block", "set_id", "n", "root", "cells")
                 .repartition(self.parts, "token", "i", "j").sortWithinPartitions("token", "i", "j"))

        def scan(batches):
            held = None
            for rows in batches:
                table = pa.Table.from_batches([rows]) if held is None else pa.concat_tables([held, pa.Table.from_batches([rows])])
                keys = np.stack([table.column(c).to_numpy() for c in (0, 1, 2)], 1)
                cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                if len(cuts):
                    yield from groups(table.slice(0, cuts[-1]), cuts)
                    table = table.slice(cuts[-1])
                held = table.combine_chunks()
            if held is not None and held.num_rows:
                yield from groups(held, np.array([held.num_rows]))

        def groups(table, ends):
            block, own, n, root = (table.column(c).to_numpy() for c in ("block", "set_id", "n", "root"))
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            cells = _cells(table.column("cells").combine_chunks())
            found = [np.zeros((0, 2), np.int64)]
            for a, b in zip([0, *ends[:-1]], ends):
                some = []
                for lo in range(a, b - 1, 64):
                    hi = min(lo + 64, b)
                    left, right = np.arange(lo, hi)[:, None], np.arange(lo + 1, b)[None]
                    apart = (left < right) & (root[left] != root[right])
                    apart &= np.minimum(n[left], n[right]) * 100 >= np.maximum(n[left], n[right]) * percent
                    if i[a] != j[a]:
                        apart &= block[left] != block[right]
                    x, y = np.nonzero(apart)
                    x, y = x + lo, y + lo + 1
                    for c in range(0, len(x), 1 << 16):
                        u, v = x[c:c + (1 << 16)], y[c:c + (1 << 16)]
                        common = np.minimum(cells[u], cells[v]).sum(1, dtype=np.int64)
                        keep = may_link(n[u], n[v], common, percent)
                        some.append((u[keep], v[keep], common[keep] / (n[u[keep]] + n[v[keep]])))
                if not some:
                    continue
                u, v, score = map(np.concatenate, zip(*some))
                if nearest:
                    member, pair = np.concatenate([u, v]), np.tile(np.arange(len(u)), 2)
                    order = np.lexsort((-score[pair], member))
                    best = np.ones(len(order), bool)
                    best[1:] = member[order[1:]] != member[order[:-1]]
                    chosen = np.unique(pair[order[best]])
                    u, v = u[chosen], v[chosen]
                found.append(np.stack([own[u], own[v]], 1))
            pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        return dealt.mapInArrow(scan, "a long, b long").distinct()

    def _sets(self, pairs: DataFrame) -> DataFrame:
        """The whole sets of the pairs, once each.  Two bits of a table of ``BITS`` bits mark
        a wanted set, so a pass over the texts sends little else; the join drops the rest."""
        wanted = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select("b")).distinct()
        shared = self.spark.sparkContext.broadcast(marked(wanted, "set_id"))

        def run(ids, sets):
            bits = shared.value
            keys = np.array([set_id(s) for s in sets], np.uint64)
            chosen = {int(keys[i]): sets[i] for i in np.flatnonzero(may_be_marked(bits, keys))}
            found = list(chosen.items())
            for i in range(0, len(found), 256):
                some = found[i:i + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.array([k for k, _ in some], np.uint64))),
                     pa.array([s.tobytes() for _, s in some], pa.binary())], names=["set_id", "tokens"])

        # Copies in different batches: equal sets are equal blobs.
        return (self._pass(run, "set_id long, tokens binary").join(wanted, "set_id", "left_semi")
                .dropDuplicates(["set_id"]))


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def may_link(n: np.ndarray, m: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with so many members and at most ``common`` in both can link."""
    return (100 * common >= percent * (n + m - common)) | (np.maximum(n, m) > CELLED)


def _pairs_table(token, member, n, hub) -> pa.Table:
    return pa.table({"token": pa.array(_signed(np.ascontiguousarray(token))) if token is not None else pa.nulls(len(member), pa.int64()),
                     "set_id": pa.array(_signed(np.ascontiguousarray(member))),
                     "n": pa.array(n.astype(np.int64)), "hub": pa.array(_signed(np.ascontiguousarray(hub)))})


def _subset_pairs(e: np.ndarray) -> pa.Table:
    """Members of each subset's list, tied to the smallest one of the other size."""
    starts = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]])) if len(e) else np.zeros(0, int)
    ends = np.append(starts[1:], len(e))
    members, hubs = [], []
    for a, b in zip(starts, ends):
        if b - a < 2:
            continue
        tags, sets = e["tag"][a:b], e["set"][a:b]
        if tags[0] == 2:
            members.append(sets)
            hubs.append(np.full(b - a, sets.min()))
        elif tags[0] != tags[-1]:
            smaller, larger = sets[tags == 0], sets[tags == 1]
            members += [larger, smaller]
            hubs += [np.full(len(larger), smaller.min()), np.full(len(smaller), larger.min())]
    member = np.concatenate(members) if members else np.zeros(0, np.uint64)
    hub = np.concatenate(hubs) if hubs else np.zeros(0, np.uint64)
    return _pairs_table(None, member, np.zeros(len(member), np.int64), hub)


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest ``doc_id`` reachable
    by links) of every document."""
    join = _Join(docs, words, percent)
    sized = staged(join.sizes(), "jaccard-sizes")
    classes = staged(sized.filter("n > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("cells").alias("cells")), "jaccard-classes")
    least = next(n for n in range(1, 1000) if overlap(n, n + 1, percent) <= n or overlap(n, n, percent) < n)
    counts = staged(join.counts(least), "jaccard-counts")
    total = counts.filter("held < 0").agg(F.sum("held"), F.sum("weighted")).first()
    mean_list = total[1] / -total[0] if total[0] else 1.0
    heavy = counts.filter("held > 0").orderBy(F.desc("held"), "token").limit(HEAVY).select("token", "held").toArrow()
    tokens = heavy.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    below = join.boundary(classes, mean_list)
    discard(counts)
    lists = staged(join.lists((tokens[order], heavy.column("held").to_numpy()[order]), below), "jaccard-lists")

    # First round: members with their hubs, and the hubs of a split list with one another.
    hubs = lists.filter("token IS NOT NULL").select("token", "hub").distinct()
    top = hubs.groupBy("token").agg(F.min("hub").alias("top"))
    first = staged(_pairs(lists, "set_id", "hub").unionByName(_pairs(hubs.join(top, "token"), "hub", "top")).distinct(), "jaccard-first")
    near = staged(join.pruned(first, classes), "jaccard-near")
    links = join.verified(near)
    discard(near)
    tried, roots = first, connected(links)
    # Second and third round: what shares a list and is still apart.
    for nearest in (True, False):
        rest = staged(join.scanned(lists, roots, classes, nearest).join(tried, ["a", "b"], "left_anti"), "jaccard-rest")
        links = links.unionByName(join.verified(rest))
        tried, roots = tried.unionByName(rest), connected(links)
    roots = staged(roots, "jaccard-roots")
    discard(lists)

    rooted = classes.select("set_id", "rep").join(roots.toDF("set_id", "root"), "set_id", "left").select(
        "set_id", "rep", F.coalesce("root", "set_id").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_set = rooted.join(smallest, "root").select("set_id", "component_id")
    return (sized.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
            .join(of_set, "set_id", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
