"""LM scoring: stupid-backoff bigram scores, computed relationally.

Every document's n-grams are dealt by hash to the partitions that hold their counts,
joined there, and what they score is summed per document:

1. A word and the one before it (or the start of the document) go to the partition of the
   word before: the counts of that context and of all its bigrams meet there.  A bigram
   seen ``MIN_COUNT`` times or more scores ``count(bigram) / count(context)``.
2. The others go on to the partition of their last word, where its unigram count has
   arrived from step 1, and score ``BACKOFF * count(word) / all words``.
3. The sums are dealt by document.

There are as many partitions as the counted words ask for (``PART_WORDS``).  A document's own
words are part of the counts, so every bigram occurs; one that occurs once is only the
document's own and backs off.

Entries travel as sorted blocks, a block a batch and partition: every distinct bigram
once, with its number and the documents that hold it.  Words so frequent that one
partition could not hold their bigrams (``HOT`` of all words or more, so at most
``2 / HOT`` words) are counted beforehand and broadcast with their counts; their bigrams
are dealt by the whole bigram.

The score of a document is the mean base-10 logarithm over its words.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded; a null, empty or wordless
text has no words and scores 0; rows with a null id take no part; rows that share an id
are one document (one result row, all their words); an empty table gives no rows; texts of
any length count and are scored whole.  Words
are told apart by 48-bit hashes within a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, long_column, packed, ready, text_bytes, trim, unpacked
from .words import mix, word_hashes, word_spans

BACKOFF = 0.4
MIN_COUNT = 2
PART_WORDS = 2_000_000  # words a partition of counts, whatever the cluster's settings
RANGES = 4  # of a partition's contexts, joined one after another
HOT = 1 / 4096
_MASK = np.uint64((1 << 48) - 1)
START = np.uint64(1)   # the context of a document's first word
END = np.uint64(0)     # what follows a document's last word; it has no score


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _block(*parts: bytes) -> bytes:
    return b"".join([len(parts).to_bytes(2, "little"), *[len(p).to_bytes(8, "little") for p in parts], *parts])


def _parts(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:2], "little")
    sizes = np.frombuffer(blob, "<u8", n, 2).astype(np.int64)
    at = 2 + 8 * n + np.cumsum(sizes) - sizes
    return [blob[a:a + s] for a, s in zip(at, sizes)]


_CODEC = pa.Codec("zstd", 1)


def _squeezed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + bytes(_CODEC.compress(raw))


def _loose(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little")), kind)


def _words(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(rows.column(1))
    starts, ends, firsts = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, lower=True) & _MASK
    return np.maximum(hashes, np.uint64(2)), firsts


def hot_words(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The hot words (sorted), their exact counts, and the numbers of words and of
    documents with words.  A word that is hot at all is hot in some partition."""
    def frequent(batches):
        # A partition's words with HOT of them or more, by merging the batches' counts.
        words, counts, total, with_words = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
        for rows in batches:
            h, firsts = _words(rows)
            total += len(h)
            with_words += int(np.count_nonzero(np.diff(firsts)))
            w, c = np.unique(h, return_counts=True)
            some = c >= HOT * len(h) / 4
            words, inverse = np.unique(np.concatenate([words, w[some]]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, c[some]]), minlength=len(words)).astype(np.int64)
        keep = counts >= HOT * total / 2
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(words[keep], 0).view(np.int64)), pa.array(np.append(counts[keep], total)),
             pa.array(np.append(np.zeros(keep.sum(), np.int64), with_words))], names=["word", "n", "docs"])

    found = (docs.mapInArrow(frequent, "word long, n long, docs long").groupBy("word")
             .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = found.filter("word = 0").first()
    if total is None or not total.n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    # At most 4 / HOT words have a quarter of HOT of all words.
    hot = np.sort(np.array([r.word for r in found.filter(F.col("n") >= HOT * total.n / 4).filter("word <> 0").collect()], np.int64).view(np.uint64))

    def exact(batches):
        counts = np.zeros(len(hot), np.int64)
        for rows in batches:
            h, _ = _words(rows)
            at = np.searchsorted(hot, h)
            at[at == len(hot)] = 0
            counts += np.bincount(at[hot[at] == h], minlength=len(hot))
        yield pa.RecordBatch.from_arrays([pa.array(hot.view(np.int64)), pa.array(counts)], names=["word", "n"])

    counts = np.zeros(len(hot), np.int64)
    if len(hot):
        for r in docs.mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
            counts[np.searchsorted(hot, np.array([r.word]).view(np.uint64))[0]] = r.n
    return hot, counts, int(total.n), int(total.docs)


def _one_range(blobs, low, high, lookup, totals, later_words, later_docs, cold_words, cold_counts) -> None:
    """Join the bigrams whose context hash is in [low, high) with their counts.  Adds what
    they score to ``totals`` (per document of each block), those that back off to the
    ``later`` lists, and the counts of contexts that are not hot to the ``cold`` lists."""
    first, second, number, docs, about = [], [], [], [], []
    for blob in blobs:
        f, spread, s, n, d, ids = _parts(blob)
        contexts, spread, n = _from_six(f), unpacked(spread), unpacked(n)
        a, b = np.searchsorted(contexts, [low, high])
        entry = np.concatenate([[0], np.cumsum(spread)])[[a, b]]
        place = np.concatenate([[0], np.cumsum(n)])[entry]
        first.append(np.repeat(contexts[a:b], spread[a:b]))
        second.append(_from_six(s[6 * entry[0]:6 * entry[1]]))
        number.append(n[entry[0]:entry[1]].astype(np.int32))
        docs.append(_loose(d, "<u2")[place[0]:place[1]].copy())
        about.append(unpacked(ids))
    lengths = [len(f) for f in first]
    if not sum(lengths):
        return
    first, second, number = np.concatenate(first), np.concatenate(second), np.concatenate(number)
    order = np.lexsort((second, first)).astype(np.int32)
    f, s = first[order], second[order]
    del first
    new_context = np.ones(len(f), bool)
    new_context[1:] = f[1:] != f[:-1]
    new = new_context.copy()
    new[1:] |= s[1:] != s[:-1]
    words = f[new_context]
    del f
    count = np.bincount(np.cumsum(new) - 1, number[order])[np.cumsum(new) - 1]
    context = np.cumsum(new_context) - 1
    of_context = np.bincount(context, number[order]).astype(np.int64)
    is_hot, exact = lookup(words)
    cold_words.append(words[~is_hot])
    cold_counts.append(of_context[~is_hot])
    seen = count >= MIN_COUNT
    value = np.where(seen, np.log10(count / np.where(is_hot, exact, of_context)[context]), 0.0)
    del count, context
    last_hot, last_exact = lookup(s)
    here = ~seen & last_hot & (s != END)  # the last word's count is known: no need to send it on
    value[here] = np.log10(last_exact[here])
    value[s == END] = 0.0
    later = ~seen & ~here & (s != END)
    back, state = np.empty(len(order)), np.zeros(len(order), np.int8)
    back[order] = value
    state[order] = np.where(here, 1, np.where(later, 2, 0))
    at = 0
    for n, d, ids in zip(lengths, docs, about):
        k = number[at:at + n]
        v, st, w = np.repeat(back[at:at + n], k), np.repeat(state[at:at + n], k), np.repeat(second[at:at + n], k)
        at += n
        touched = np.unique(d)
        totals["ids"].append(ids[touched])
        totals["sum"].append(np.bincount(d, v, minlength=len(ids))[touched])
        totals["backed"].append(np.bincount(d[st == 1], minlength=len(ids))[touched])
        later_words.append(w[st == 2])
        later_docs.append(ids[d[st == 2]])


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words`` and ``score`` of every document, by the counts of all."""
    spark = docs.sparkSession
    ready(spark)
    docs = documents(docs)
    hot, hot_counts, n_all, n_started = hot_words(docs)
    parts = max(1, -(-n_all // PART_WORDS))
    # The start is a context like a hot word: its count is the number of started documents.
    known = np.append(hot, START)
    order = np.argsort(known)
    shared = spark.sparkContext.broadcast((known[order], np.append(hot_counts, n_started)[order]))

    def lookup(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is hot, and its count if so."""
        known, counts = shared.value
        at = np.searchsorted(known, words)
        at[at == len(known)] = 0
        return known[at] == words, counts[at]

    def explode(batches):
        """Blocks of bigrams by partition, and the numbers of words by document."""
        for rows in batches:
            ids = long_column(rows.column(0))
            h, firsts = _words(rows)
            sizes = np.diff(firsts)
            out = []
            by_doc = np.argsort(ids, kind="stable")
            for p in np.unique(ids % parts):
                mine = by_doc[ids[by_doc] % parts == p]
                out.append((2 * parts + int(p), _block(packed(ids[mine]), _squeezed(np.zeros(len(mine))), packed(np.zeros(len(mine), np.int64)), packed(sizes[mine]))))
            if len(h):
                # One entry a word with the word before, and one for each last word.
                doc = np.repeat(np.arange(len(ids)), sizes)
                begin = np.zeros(len(h), bool)
                begin[firsts[:-1][sizes > 0]] = True
                before = np.where(begin, START, np.concatenate([[START], h[:-1]]))
                last = h[firsts[1:][sizes > 0] - 1]
                first, second = np.concatenate([before, last]), np.concatenate([h, np.full(len(last), END)])
                doc = np.concatenate([doc, np.flatnonzero(sizes > 0)]).astype(np.uint16)
                is_hot, _ = lookup(first)
                key = np.where(is_hot, mix(first * np.uint64(3) + second), mix(first))
                part = (key % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
                order = np.lexsort((second, first, part))
                first, second, doc, part = first[order], second[order], doc[order], part[order]
                new = np.ones(len(order), bool)
                new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (part[1:] != part[:-1])
                head = np.flatnonzero(new)
                number = np.diff(np.append(head, len(order)))
                found, at = np.unique(part[head], return_index=True)
                about = packed(ids)
                for p, a, b in zip(found, at, [*at[1:], len(head)]):
                    f, s, n = first[head[a:b]], second[head[a:b]], number[a:b]
                    context = np.ones(b - a, bool)
                    context[1:] = f[1:] != f[:-1]
                    begins = np.flatnonzero(context)
                    out.append((int(p), _block(
                        _six(f[begins]), packed(np.diff(np.append(begins, b - a))), _six(s), packed(n),
                        _squeezed(doc[head[a]:head[a] + int(n.sum())]), about)))
            yield from _rows(out)

    def _rows(out):
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out[i:i + 256]], pa.int32()),
                                              pa.array([x for _, x in out[i:i + 256]], pa.binary())], names=["pid", "blob"])

    def table(out) -> pa.Table:
        return pa.table({"pid": pa.array([p for p, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    def sums(ids, total, backed) -> list[tuple[int, bytes]]:
        """Partial sums dealt by document; ids ascending and distinct."""
        zero = np.zeros(len(ids), np.int64)
        return [(2 * parts + int(p), _block(packed(ids[at]), _squeezed(total[at]), packed(backed[at]), packed(zero[at])))
                for p in np.unique(ids % parts) for at in [ids % parts == p]]

    def contexts(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pid, blobs = key[0].as_py(), group.column("blob").to_pylist()
        if pid >= 2 * parts:
            return table([(pid, b) for b in blobs])
        totals: dict[str, list] = {"ids": [], "sum": [], "backed": []}
        later_words, later_docs, cold_words, cold_counts = [], [], [], []
        # A block is sorted by context, so a range of contexts is a slice of each block.
        edges = np.linspace(0, 1 << 48, RANGES + 1).astype(np.uint64)
        for low, high in zip(edges, edges[1:]):
            trim()
            _one_range(blobs, low, high, lookup, totals, later_words, later_docs, cold_words, cold_counts)
        out = []
        ids, inverse = np.unique(np.concatenate(totals["ids"]), return_inverse=True)
        out += sums(ids, np.bincount(inverse, np.concatenate(totals["sum"])),
                    np.bincount(inverse, np.concatenate(totals["backed"])).astype(np.int64))
        w, d = np.concatenate(later_words), np.concatenate(later_docs)
        part = (mix(w) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((d, part))
        found, begin = np.unique(part[order], return_index=True)
        for p, a, b in zip(found, begin, [*begin[1:], len(order)]):
            out.append((parts + int(p), _block(_six(w[order[a:b]]), packed(d[order[a:b]]))))
        words, counts = np.concatenate(cold_words), np.concatenate(cold_counts)
        if len(words):  # the unigram counts of this partition's own words
            out.append((parts + pid, _block(_six(words), packed(counts), b"")))
        return table(out)

    def unigrams(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pid, blobs = key[0].as_py(), group.column("blob").to_pylist()
        if pid >= 2 * parts:
            return table([(pid, b) for b in blobs])
        words, counts, wanted, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
        for blob in blobs:
            p = _parts(blob)
            if len(p) == 3:
                words.append(_from_six(p[0]))
                counts.append(unpacked(p[1]))
            else:
                wanted.append(_from_six(p[0]))
                docs.append(unpacked(p[1]))
        if not wanted:
            return table([])
        words, counts = np.concatenate(words), np.concatenate(counts)
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        value = np.log10(counts[np.searchsorted(words, np.concatenate(wanted))])
        ids, inverse = np.unique(np.concatenate(docs), return_inverse=True)
        return table(sums(ids, np.bincount(inverse, value), np.bincount(inverse)))

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        columns = [[], [], [], []]
        for blob in group.column("blob").to_pylist():
            ids, total, backed, words = _parts(blob)
            for c, x in zip(columns, (unpacked(ids), _loose(total, "<f8"), unpacked(backed), unpacked(words))):
                c.append(x)
        ids, total, backed, words = map(np.concatenate, columns)
        ids, inverse = np.unique(ids, return_inverse=True)
        return pa.table({"doc_id": pa.array(ids), "total": pa.array(np.bincount(inverse, total)),
                         "backed": pa.array(np.bincount(inverse, backed).astype(np.int64)),
                         "n_words": pa.array(np.bincount(inverse, words).astype(np.int64))})

    blocks = "pid int, blob binary"
    found = (docs.mapInArrow(explode, blocks).groupBy("pid").applyInArrow(contexts, blocks)
             .groupBy("pid").applyInArrow(unigrams, blocks)
             .groupBy("pid").applyInArrow(add, "doc_id long, total double, backed long, n_words long"))
    penalty = float(np.log10(BACKOFF) - np.log10(max(n_all, 1)))
    return found.select("doc_id", "n_words", F.when(
        F.col("n_words") > 0, (F.col("total") + F.col("backed") * penalty) / F.col("n_words")).otherwise(0.0).alias("score"))


# The same model in SQL.  The last word of a document is counted as a context too.
ORACLE_SQL = """
WITH tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
pairs AS (SELECT doc_id, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before, word FROM placed),
one AS (SELECT word, count(*) AS n FROM placed GROUP BY word),
two AS (SELECT before, word, count(*) AS n FROM pairs GROUP BY before, word),
totals AS (SELECT (SELECT count(*) FROM placed) AS words, (SELECT count(*) FROM tokens WHERE len(w) > 0) AS started),
scored AS (
  SELECT p.doc_id, CASE WHEN t.n >= 2 THEN log10(t.n::DOUBLE / coalesce(c.n, totals.started))
                        ELSE log10(0.4 * u.n / totals.words) END AS s
  FROM pairs p JOIN two t ON t.before IS NOT DISTINCT FROM p.before AND t.word = p.word
  JOIN one u ON u.word = p.word LEFT JOIN one c ON c.word = p.before CROSS JOIN totals)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, round(coalesce(s.score, 0.0), 6) AS score
FROM tokens t LEFT JOIN (SELECT doc_id, avg(s) AS score FROM scored GROUP BY doc_id) s USING (doc_id)
"""
