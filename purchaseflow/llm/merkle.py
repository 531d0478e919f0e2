"""Merkle manifest of a table: every row a leaf, with the siblings that prove it.

A leaf is the hash of its fields; the leaves of a language ascend by ``doc_id``, and while
several nodes remain, every two consecutive ones (a last lone one by itself) become their
hash.  The subroots, ordered by language, give the root in the same way.

Incremental witnesses: nodes are appended one by one to a stack of open subtrees that are
aligned at powers of two.  Each node's witness grows with every sibling that is completed:
when two subtrees of a height meet, the right one's hash is attached to all nodes of the
left one and the left one's to all nodes of the right one.  Distributed: leaves are sorted
by range, numbered by prefix sums over the partitions, and dealt as aligned blocks of
``2 ** LEVELS``; the block roots are appended to further blocks, and so on until one node
a language is left.  Then the witness of each block's root is handed down and extends the
witnesses of its members.  Texts are hashed where they are read and never shuffled; a
language with a third of all rows is many blocks, and a task holds one block at a time.

Defined results: a null field is ``-`` in its leaf, so rows with a null ``doc_id`` or null
text are leaves too (null ids first); rows with equal ids are ordered by their leaf hash,
and repeated rows are leaves each.  A null language is a language of its own, before all
others.  A text of any length is one leaf.  An empty table has no rows and no root.  A
count of characters at the largest long is raised beyond it, as a number.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged

LEVELS = 10
NO_SIBLING, LEFT, RIGHT = "-", "L", "R"

_NODES = "grp string, pos long, size long, node string, doc_id long, changed string"
_BLOCKS = "grp string, pos long, size long, node string, members array<string>, ids array<long>, changes array<string>"
_PROOFS = "grp string, pos long, node string, doc_id long, changed string, witness array<string>, subroot string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


class OpenSubtrees:
    """Complete aligned subtrees, largest first, and a witness of each appended node."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, int, str]] = []  # level, first node, end, hash
        self.witness: list[list[str]] = []

    def append(self, node: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self.open.append((0, n, n + 1, node))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._meet()

    def _meet(self) -> None:
        """The last two subtrees become one; each is the other's sibling."""
        level, middle, end, right = self.open.pop()
        _, first, _, left = self.open.pop()
        for seen in self.witness[first:middle]:
            seen.append(RIGHT + right)
        for seen in self.witness[middle:end]:
            seen.append(LEFT + left)
        self.open.append((level + 1, first, end, digest(left, right)))

    def close(self, level: int | None) -> str:
        """The root at ``level`` (None: as soon as one node is left).  A last subtree that
        has no sibling at its height becomes its own hash."""
        while True:
            height, first, end, node = self.open[-1]
            if len(self.open) == 1 and (level is None or height == level):
                return node
            if len(self.open) > 1 and self.open[-2][0] == height:
                self._meet()
                continue
            for seen in self.witness[first:end]:
                seen.append(NO_SIBLING)
            self.open[-1] = (height + 1, first, end, digest(node))


def subtree(members: list[str], alone: bool, levels: int) -> tuple[str, list[list[str]]]:
    """Root and witnesses of an aligned block; ``alone``: it is the whole tree."""
    stack = OpenSubtrees()
    for node in members:
        stack.append(node)
    return stack.close(None if alone else levels), stack.witness


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.when(text.isNull(), NO_SIBLING).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def leaves(docs: DataFrame, changed: Column | None = None, changed_n_chars: Column | None = None) -> DataFrame:
    """``grp`` (the language; orders as the languages do, null first), ``doc_id``, the
    ``node`` hash, and the hash that rows where ``changed`` holds have by then."""
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    fields = [F.col("source"), F.col("lang")]
    other = F.lit(None).cast("string") if changed is None else F.when(
        F.coalesce(changed, F.lit(False)), leaf_hash(doc_id, *fields, changed_n_chars, F.col("text")))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"), doc_id.alias("doc_id"),
                       leaf_hash(doc_id, *fields, n_chars, F.col("text")).alias("node"), other.alias("changed"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Nodes with their place ``pos`` in their group (by ``doc_id``, then hash) and its ``size``."""
    # The last key splits rows that are alike; which of them comes first doesn't matter.
    order = ["grp", "doc_id", "node"]
    placed = staged(rows.withColumn("salt", F.monotonically_increasing_id())
                    .repartitionByRange(*order, "salt").sortWithinPartitions(*order).drop("salt")
                    .withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    # One row a partition and group.
    runs = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("grp")
    runs = runs.select("grp", "part", "first", F.sum("n").over(whole).alias("size"), F.coalesce(
        F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (placed.withColumn("part", part).join(runs, ["grp", "part"])
            .select("grp", (F.col("base") + F.col("at") - F.col("first")).alias("pos"), "size", "node", "doc_id", "changed"))


def blocks(nodes: DataFrame, levels: int, name: str) -> DataFrame:
    """Aligned blocks of ``2 ** levels`` nodes with their roots, which are the nodes of the
    next blocks: ``pos`` and ``size`` count blocks."""
    def build(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        grp, pos, size = (block.column(c)[0].as_py() for c in ("grp", "pos", "size"))
        members = block.column("node").to_pylist()
        node = subtree(members, size <= 1 << levels, levels)[0]
        return pa.table({"grp": [grp], "pos": [pos >> levels], "size": [-(-size >> levels)], "node": [node],
                         "members": [members], "ids": [block.column("doc_id").to_pylist()],
                         "changes": [block.column("changed").to_pylist()]},
                        schema=pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("node", pa.string()),
                                          ("members", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())),
                                          ("changes", pa.list_(pa.string()))]))

    return staged(nodes.groupBy("grp", F.shiftright("pos", levels).alias("block"))
                  .applyInArrow(build, _BLOCKS), name)


def tree(nodes: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The blocks of all heights, leaves first, up to one node a group; none for no nodes."""
    heights: list[DataFrame] = []
    while True:
        if not heights or largest > 1:
            heights.append(blocks(nodes, levels, f"{name}-{len(heights)}"))
            largest = heights[-1].agg(F.max("size")).first()[0] or 0
            nodes = heights[-1].select("grp", "pos", "size", "node", F.lit(None).cast("long").alias("doc_id"),
                                       F.lit(None).cast("string").alias("changed"))
        else:
            return heights


def handed_down(heights: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Witnesses of all members of the lowest blocks.  ``top``: ``grp``, ``pos`` 0, and the
    witness, subroot and root of each group's single node."""
    def extend(batches):
        for rows in batches:
            for row in rows.to_pylist():
                members = row["members"]
                # size counts blocks: a single one is the whole tree of its group
                inner = subtree(members, row["size"] == 1, levels)[1]
                n, first = len(members), row["pos"] << levels
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * n), pa.array(range(first, first + n), pa.int64()), pa.array(members),
                     pa.array(row["ids"], pa.int64()), pa.array(row["changes"], pa.string()),
                     pa.array([w + row["witness"] for w in inner], pa.list_(pa.string())),
                     pa.array([row["subroot"]] * n, pa.string()), pa.array([row["root"]] * n, pa.string())],
                    names=["grp", "pos", "node", "doc_id", "changed", "witness", "subroot", "root"])

    for height in reversed(heights):
        top = (height.drop("node").join(top.select("grp", "pos", "witness", "subroot", "root"), ["grp", "pos"])
               .mapInArrow(extend, _PROOFS))
    return top


def manifest(docs: DataFrame, changed: Column | None = None, changed_n_chars: Column | None = None,
             levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``changed_leaf`` (null if unchanged), ``subroot``, ``root`` and
    the ``witness`` of every row: per height ``L`` or ``R`` and the hash of the sibling on
    that side, or ``-`` where the node had none."""
    spark = docs.sparkSession
    ready(spark)
    heights = tree(numbered(leaves(docs, changed, changed_n_chars), "merkle-leaves"), levels, "merkle")
    # The single node of each language is a leaf of the tree over all languages.
    subroots = heights[-1].select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("doc_id"),
                                  F.col("node").alias("subroot"), F.col("grp").alias("node"), F.lit(None).cast("string").alias("changed"))
    placed = numbered(subroots.drop("subroot"), "merkle-langs").withColumnRenamed("node", "lang")
    langs = staged(placed.join(heights[-1].select(F.col("grp").alias("lang"), "node"), "lang"), "merkle-subroots")
    upper = tree(langs.drop("lang"), levels, "merkle-upper")
    none = F.array().cast("array<string>")
    over = handed_down(upper, upper[-1].select("grp", "pos", none.alias("witness"), F.lit(None).cast("string").alias("subroot"),
                                               F.col("node").alias("root")), levels)
    top = (langs.select("pos", "lang").join(over.select("pos", "node", "witness", "root"), "pos")
           .select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("pos"), "witness", F.col("node").alias("subroot"), "root"))
    proofs = handed_down(heights, staged(top, "merkle-top"), levels)
    return proofs.select("doc_id", F.col("node").alias("leaf"), F.col("changed").alias("changed_leaf"), "subroot", "root", "witness")


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    hash_of = lambda text: F.sha2(text.cast("binary"), 256)
    return F.aggregate(witness, leaf, lambda node, step: F.when(step == NO_SIBLING, hash_of(node))
                       .when(F.substring(step, 1, 1) == LEFT, hash_of(F.concat(F.substring(step, 2, 64), node)))
                       .otherwise(hash_of(F.concat(node, F.substring(step, 2, 64)))))


def verified(rows: DataFrame) -> DataFrame:
    """The manifest with a digest of each proof, the root that the row as it is now folds
    to, and whether that is the manifest's."""
    siblings = F.array_join(F.transform(F.filter("witness", lambda s: s != NO_SIBLING), lambda s: F.substring(s, 2, 64)), "")
    return (rows.withColumn("folded_root", folded(F.coalesce("changed_leaf", "leaf"), F.col("witness")))
            .select("doc_id", "leaf", "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def tampered() -> tuple[Column, Column]:
    """Which rows the query changes, and their number of characters by then."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    return hit, F.col("n_chars").cast("long").cast("decimal(20,0)") + F.lit(1)
