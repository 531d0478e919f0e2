"""Order statistics of a large table without sorting it.

To find the rows at some places of the sorted table, a sample of its keys is sorted and
gives, for each place, two keys that enclose it with near certainty.  One pass over the keys
counts exactly what lies below the lower one and keeps what lies between the two: about
``n ** (2/3)`` of n keys, whose sort then gives the row.  If a place is outside its keys
after all, the pass is repeated for it without them, so the result is always exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..session import drop_scratch, scratch_path

SAMPLE = 4096  # keys of a sample at least
MARGIN = 4.0   # standard deviations that the enclosing keys keep from a place


@dataclass
class Place:
    """The key at a place of the sorted table, how many keys are less, how many equal."""
    key: Row
    before: int
    equal: int


class Sorted:
    """Rows sorted by range, numbered by one row a partition; stored until ``drop``."""

    def __init__(self, rows: DataFrame, order: list[str], sort: bool = True):
        self.spark = rows.sparkSession
        self.path = scratch_path(self.spark, "sorted")
        if sort:
            # The last key splits rows that are alike; which of them comes first doesn't matter.
            rows = (rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*order, "_salt")
                    .sortWithinPartitions(*order).drop("_salt"))
        rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(self.path)
        self.rows = self.spark.read.parquet(self.path)
        self.parts = self.rows.groupBy(F.shiftright("_at", 33).alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).orderBy("part").collect()
        self.n = sum(p.n for p in self.parts)

    def id_at(self, place: int) -> int:
        for p in self.parts:
            if place < p.n:
                return p.first + place
            place -= p.n
        raise IndexError(place)

    def at(self, places: list[int]) -> dict[int, Row]:
        ids = {self.id_at(p): p for p in places}
        found = self.rows.filter(F.col("_at").isin(list(ids))).collect() if ids else []
        return {ids[r["_at"]]: r for r in found}

    def drop(self) -> None:
        drop_scratch(self.spark, self.path)


def literal(df: DataFrame, key: Row, columns: list[str]) -> Column:
    return F.struct(*[F.lit(key[c]).cast(df.schema[c].dataType).alias(c) for c in columns])


def places_of(keys: DataFrame, places: list[int], n: int) -> list[Place]:
    """The keys at ``places`` of the ``n`` rows of ``keys``, sorted by all its columns."""
    columns = keys.columns
    sample = Sorted(keys.sample(min(1.0, max(SAMPLE, n ** (2 / 3)) / n), seed=17), columns)
    enclosing = []
    for place in places:
        q = place / n
        margin = MARGIN * sqrt(sample.n * q * (1 - q)) + 2
        low, high = floor(q * sample.n - margin), ceil(q * sample.n + margin)
        enclosing.append((low if low >= 0 else None, high if high < sample.n else None))
    known = sample.at(sorted({i for pair in enclosing for i in pair if i is not None}))
    sample.drop()
    return _enclosed(keys, places, [tuple(None if i is None else known[i] for i in pair) for pair in enclosing])


def _enclosed(keys: DataFrame, places: list[int], enclosing: list[tuple[Row | None, Row | None]]) -> list[Place]:
    columns, seen = keys.columns, Observation()
    value, true = F.struct(*columns), F.lit(True)
    between, below = [], []
    for i, (low, high) in enumerate(enclosing):
        low_key, high_key = (None if k is None else literal(keys, k, columns) for k in (low, high))
        between.append((true if low is None else value >= low_key) & (true if high is None else value <= high_key))
        below.append(F.count_if(F.lit(False) if low is None else value < low_key).alias(f"below_{i}"))
    which = F.filter(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(between)]), lambda i: i.isNotNull())
    # Written before it is sorted: the counts must see the keys in one job only.
    spark, kept = keys.sparkSession, scratch_path(keys.sparkSession, "enclosed")
    keys.observe(seen, *below).select(F.explode(which).alias("_which"), *columns).write.parquet(kept)
    inside = Sorted(spark.read.parquet(kept), ["_which", *columns])
    drop_scratch(spark, kept)
    sizes = {r["_which"]: r["count"] for r in inside.rows.groupBy("_which").count().collect()}
    found: list[Place | None] = []
    starts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(len(places))]
    wanted = {i: p - seen.get[f"below_{i}"] for i, p in enumerate(places)}
    hit = {i: starts[i] + w for i, w in wanted.items() if 0 <= w < sizes.get(i, 0)}
    rows = inside.at(sorted(set(hit.values())))
    counts = {}
    if hit:
        cond = {i: literal(keys, rows[at], columns) for i, at in hit.items()}
        counts = inside.rows.agg(*[F.count_if((F.col("_which") == i) & (value < k)).alias(f"before_{i}") for i, k in cond.items()],
                                 *[F.count_if((F.col("_which") == i) & value.eqNullSafe(k)).alias(f"equal_{i}") for i, k in cond.items()]).first()
    for i in range(len(places)):
        found.append(Place(rows[hit[i]], seen.get[f"below_{i}"] + counts[f"before_{i}"], counts[f"equal_{i}"]) if i in hit else None)
    inside.drop()
    return [p or _enclosed(keys, [places[i]], [(None, None)])[0] for i, p in enumerate(found)]
