"""Class weights and oversampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.neighbours import BLOCK, nearest
from netloom.operators.ranking import with_rank
from netloom.sources.sinks import small_side, stored

#: Rows that are drawn from one row at a time.
PIECE = 10_000


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight): balanced weights n / (k * n_c)."""
    every = Window.partitionBy()
    weight = F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))
    return class_counts(df, target).withColumn("weight", weight)


def with_class_weight(df: DataFrame, target: str) -> DataFrame:
    weights = class_weights(df, target).select(F.col(target).alias("__class"), F.col("weight").alias("class_weight"))
    return df.join(small_side(weights, "class-weights"), F.col(target).eqNullSafe(F.col("__class")), "left").drop("__class")


def focal_alpha(df: DataFrame, target: str, classes: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """(target, n, alpha) over all ``classes``, also those without rows: inverse counts over their mean, cut to [low, high]."""
    counts = classes.select(target).join(class_counts(df, target), target, "left").fillna(0, "n")
    inverse = 1.0 / F.greatest(F.col("n"), F.lit(1))
    counts = counts.withColumn("inverse", inverse)
    alpha = F.col("inverse") / F.avg("inverse").over(Window.partitionBy())
    return counts.select(target, "n", F.least(F.greatest(alpha, F.lit(low)), F.lit(high)).alias("alpha"))


def smote(df: DataFrame, features: Sequence[str], target: str, key: str, seed: int = 42, neighbours: int = 5, chunk: int = BLOCK) -> DataFrame:
    """The rows, and synthetic ones until every class has as many as the largest.

    A synthetic row lies between a row and one of its k nearest of the same class,
    k = min(neighbours, max(1, smallest class - 1)); nothing is added if a class has
    fewer than two rows. Neighbours are sought in the whole class, in rings of
    ``chunk`` rows (see ``neighbours``); the rows made do not depend on ``chunk``.
    Output: target, features, synthetic.
    """
    counts = class_counts(df, target).agg(F.min("n").alias("least"), F.max("n").alias("most")).first()
    own = df.select(target, *features, F.lit(False).alias("synthetic"))
    if not counts.least or counts.least < 2:
        return own
    k = min(neighbours, max(1, counts.least - 1))
    sizes = class_counts(df, target).withColumn("__class", F.row_number().over(Window.orderBy(target))).withColumn("__missing", F.lit(counts.most) - F.col("n")).filter("__missing > 0")
    sizes = small_side(sizes.select(F.col(target).alias("__target"), "__class", "n", "__missing"), "classes")
    short = df.select(target, F.col(key).alias("__key"), *[F.col(c).cast("double").alias(c) for c in features]).join(sizes, F.col(target).eqNullSafe(F.col("__target")))
    ranked = with_rank(short, F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(4096)), [F.col("__key"), *[F.col(c) for c in features]], ["__class"], "__rank")
    rows = stored(ranked.select("__class", "__rank", "n", *features), "rows")
    found = nearest(rows.select(F.col("__class").alias("g"), F.col("__rank").alias("id"), F.array(*features).alias("x")), k, chunk)
    near = found.select(F.col("g").cast("int").alias("__class"), F.col("id").alias("__rank"), "near")

    # The i-th row that a class lacks is drawn by hashes: a row of the class, one of its neighbours, a place between.
    first = F.col("__piece") * PIECE
    pieces = sizes.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__missing") - 1) / PIECE)))).repartition("__class", "__piece")
    draws = pieces.withColumn("__i", F.explode(F.sequence(first, F.least(F.col("__missing"), first + PIECE) - 1)))
    drawn = [F.xxhash64("__class", "__i", F.lit(seed), F.lit(i)) for i in range(3)]
    draws = draws.select("__target", "__class", (F.pmod(drawn[0], F.col("n")) + 1).alias("__rank"), F.pmod(drawn[1], F.lit(k)).cast("int").alias("__pick"), (F.shiftrightunsigned(drawn[2], 11) / 2.0**53).alias("__part"))
    draws = draws.join(near, ["__class", "__rank"]).withColumn("__near", F.element_at("near", F.col("__pick") + 1)).drop("near")
    draws = draws.join(rows.drop("n"), ["__class", "__rank"])
    others = rows.select("__class", F.col("__rank").alias("__near"), *[F.col(c).alias(f"__to_{c}") for c in features])
    made = draws.join(others, ["__class", "__near"])
    made = made.select(F.col("__target").alias(target), *[(F.col(c) + F.col("__part") * (F.col(f"__to_{c}") - F.col(c))).alias(c) for c in features], F.lit(True).alias("synthetic"))
    return own.select(target, *[F.col(c).cast("double").alias(c) for c in features], "synthetic").unionByName(made)
