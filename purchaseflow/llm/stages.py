"""The stages of the corpus pipeline: each applies one operator to the documents that the
stage before kept, and returns documents (the last one: pieces of packed sequences).

All columns of a row are kept, whatever else the table holds.  Decisions belong to rows:
the two filters decide by the row's own text; the other stages know a row by its id, or by
a hash of id and text where the id is null or not the row's alone.  So texts that share an
id are told apart, and only packing, whose pieces are named by their document, leaves rows
with a null id out.  Null and empty texts are never near copies and hold no repeats; empty
tables stay empty; texts of any length are judged whole."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import jaccard, packing, quality, substrings, toxicity
from .common import staged, table
from .queries import VOCABULARY


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the caller's table doesn't hold."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """The rows with a ``key``: their id, or a hash of id and text (2^62 and over) where the
    id is null or stands in several rows; and whether any row has such a hash."""
    doc_id = F.col("doc_id").cast("long")
    own = f"{key}_id"
    shared = staged(docs.select(doc_id.alias(own)).groupBy(own).agg(F.count("*").alias("n"))
                    .filter(F.col(own).isNull() | (F.col("n") > 1)).select(own), "pipeline-shared-ids")
    if shared.isEmpty():
        return docs.withColumn(key, doc_id), False
    # Its measured size decides whether Spark broadcasts it.
    rows = docs.join(shared.filter(F.col(own).isNotNull()), doc_id == F.col(own), "left")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("row"), doc_id, F.col("text")), 2).bitwiseOR(F.lit(1 << 62))
    return rows.withColumn(key, F.when(F.col(own).isNotNull() | doc_id.isNull(), hashed).otherwise(doc_id)).drop(own), True


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents predicted toxic go.  One pass, no row moves."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(spark, model, F.col("text")) < toxicity.CUTOFF)


def with_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents predicted poor go (none without labels).  One pass, no row moves."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs if model is None else docs.filter(quality.score_column(spark, model, F.col("text")) >= quality.CUTOFF)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: of each component one document stays, that
    of the smallest key (so of the smallest id that is one row's alone).  Of rows alike in id
    and text the first by their other columns stays."""
    key = fresh(docs, "row_key")
    rows, hashed = keyed(docs, key)
    found = jaccard.components(rows.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    if hashed:  # rows alike share a key: one stays, chosen before any shuffle
        place = fresh(rows, "row_place")
        others = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
        rows = (rows.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*others)))
                .filter(F.col(place) == 1).drop(place))
    return rows.join(kept.hint("merge"), key, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: a text with repeated passages becomes its kept words joined by one
    space (``n_chars`` follows); other texts stay as they are."""
    key, starts, ends, new_text = (fresh(docs, c) for c in ("row_key", "span_starts", "span_ends", "kept_text"))
    rows, _ = keyed(docs, key)
    spans = staged(substrings.repeats(rows.select(F.col(key).alias("doc_id"), "text")), "pipeline-repeats").select(
        F.col("doc_id").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends))

    @F.arrow_udf("string")
    def kept(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([None if a is None else substrings.without_spans(t or "", a, b)[2]
                         for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist())], pa.string())

    joined = rows.join(spans.hint("merge"), key, "left").withColumn(new_text, kept("text", starts, ends))
    new = {"text": F.coalesce(new_text, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(new_text).isNull(), F.col("n_chars")).otherwise(
            F.char_length(new_text).cast(docs.schema["n_chars"].dataType))
    return joined.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the remaining documents as pieces of sequences of 4096 tokens."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path(VOCABULARY)))
