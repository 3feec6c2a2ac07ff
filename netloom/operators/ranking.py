"""Exact ranks over whole tables without sorting them in one task.

Rows fall into buckets that keep the order (such as a prefix of the sort key).
Bucket counts, added up in order, give each bucket's first rank; within a bucket
a window numbers the rows. Only bucket counts meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.sources.sinks import stored


def with_rank(df: DataFrame, bucket: Column, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add ``name``: the 1-based rank by ``order`` among all rows, or among those of equal ``by`` columns.

    ``bucket`` must not fall where ``order`` rises. Ties take ranks in any order.
    """
    by = list(by)
    marked = df.withColumn("__bucket", bucket)
    counts = marked.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bucket").alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*by, "__bucket").orderBy(*order)
    on = F.col("__bucket").eqNullSafe(F.col("__own"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    ranked = marked.withColumn("__row", F.row_number().over(within)).join(offsets, on)
    return ranked.withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__bucket", "__own", "__before", "__row", *[f"__{c}" for c in by])


def hash_key(columns: Sequence[str], seed: int = 0) -> Column:
    """A hexadecimal key that shuffles rows the same way every time; a null reads as an empty text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def with_hash_rank(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), seed: int = 0, name: str = "rank") -> DataFrame:
    """Ranks in the order of ``hash_key``: a shuffle of the table that any number of tasks can share."""
    keyed = df.withColumn("__key", hash_key(columns, seed))
    return with_rank(keyed, F.substring("__key", 1, 3), [F.col("__key"), *[F.col(c) for c in columns]], by, name).drop("__key")


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Add ``name``: the place from 0 in the order, for any keys and however many rows are equal.

    The table is range-partitioned, written sorted, and each partition's first
    place follows from the partitions' row counts; these alone meet in one task.
    Rows with equal keys take places in any order.
    """
    keys = {f"__key{i}": c for i, c in enumerate(order)} | {"__row": F.monotonically_increasing_id()}
    rows = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    rows = stored(rows.withColumn("__place", F.monotonically_increasing_id()), "positions").withColumn("__part", F.shiftright("__place", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    parts = parts.select(F.col("__part"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    # A row for each partition: some thousands at most.
    return rows.join(F.broadcast(parts), "__part").withColumn(name, F.col("__place") + F.col("__shift")).drop("__part", "__place", "__shift")
