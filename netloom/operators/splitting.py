"""Deterministic shuffles, samples, shards and stratified splits, all in hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ranking import hash_key, with_hash_rank
from netloom.sources.sinks import small_side, stored


def sample_n(df: DataFrame, n: int, columns: Sequence[str], seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are no more: the first in hash order of ``columns``.

    Rows are counted by the first 16 bits of their hash; only those up to the
    prefix that reaches n are ranked, so a small sample shuffles little.
    """
    prefix = F.substring("__key", 1, 4)
    keyed = df.withColumn("__key", hash_key(columns, seed))
    running = F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
    counts = keyed.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", running)
    last = counts.filter(F.col("upto") >= n).agg(F.min("prefix")).first()[0]
    # Stored: few more rows than n, which are read twice.
    near = stored(keyed.filter(prefix <= last).drop("__key"), "sample") if last is not None else df
    return with_hash_rank(near, columns, seed=seed, name="__rank").filter(F.col("__rank") <= n).drop("__rank")


def shards(df: DataFrame, k: int, columns: Sequence[str], seed: int = 0, name: str = "device_id") -> DataFrame:
    """Add ``name``: 1 to k, near-equal chunks of the shuffled table; the first n mod k are one row larger."""
    n = df.count()
    size, more = divmod(n, k)
    at = F.col("__rank") - 1
    edge = more * (size + 1)
    late = F.lit(more) + F.floor((at - edge) / max(size, 1))
    chunk = F.when(at < edge, F.floor(at / (size + 1))).otherwise(late)
    return with_hash_rank(df, columns, seed=seed, name="__rank").withColumn(name, (chunk + 1).cast("int")).drop("__rank")


def quotas(counts: DataFrame, target: str, n: str, size: Column, name: str) -> DataFrame:
    """Add ``name`` to (target, n): shares of ceil(size), by floors and then the largest remainders, ties by class."""
    every = Window.partitionBy()
    exact = F.col(n) * F.col("__size") / F.sum(n).over(every)
    counts = counts.withColumn("__size", F.ceil(size)).withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    place = F.row_number().over(Window.orderBy((F.col("__exact") - F.col("__floor")).desc(), target))
    extra = (place <= F.col("__size") - F.sum("__floor").over(every)).cast("long")
    return counts.withColumn(name, (F.col("__floor") + extra).cast("long")).drop("__size", "__exact", "__floor")


def _class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def _in_parts(df: DataFrame, target: str, columns: Sequence[str], seed: int, limits: DataFrame, cuts: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Add ``part``: a row's class takes names[i] for ranks in hash order up to its limit cuts[i] (they rise), then the last name.

    limits: (__class, cuts), a row for each class. Rows are counted by the first
    digits of their hash; only those whose digits a limit falls among are ranked, the
    others stay where they are.
    """
    key, digits, own = F.col("__key"), F.col("__digits"), F.col(target).eqNullSafe(F.col("__class"))
    keyed = df.withColumn("__key", hash_key(columns, seed)).withColumn("__digits", F.substring("__key", 1, 3))
    upto = F.sum("n").over(Window.partitionBy(target).orderBy("__digits").rowsBetween(Window.unboundedPreceding, 0))
    counts = keyed.groupBy(target, "__digits").agg(F.count(F.lit(1)).alias("n")).withColumn("__upto", upto)
    held = lambda c: (F.col("__upto") - F.col("n") < F.col(c)) & (F.col(c) <= F.col("__upto"))
    found = [x for i, c in enumerate(cuts) for x in (F.coalesce(F.max(F.when(held(c), digits)), F.lit("")).alias(f"__at{i}"), F.max(F.when(held(c), F.col("__upto") - F.col("n"))).alias(f"__before{i}"))]
    edges = counts.join(limits, own).groupBy("__class", *cuts).agg(*found)
    placed = keyed.join(small_side(edges, "edges"), own)
    at = [F.col(f"__at{i}") for i in range(len(cuts))]
    cut_through = digits.isin(*at)

    def part(within: Sequence[Column]) -> Column:
        out = F.when(within[0], names[0])
        for w, name in zip(within[1:], names[1:], strict=False):
            out = out.when(w, name)
        return out.otherwise(names[-1])

    whole = placed.filter(~cut_through).withColumn("part", part([digits < a for a in at]))
    before = F.coalesce(*[F.when(digits == a, F.col(f"__before{i}")) for i, a in enumerate(at)])
    rank = before + F.row_number().over(Window.partitionBy(target, "__digits").orderBy(key, *[F.col(c) for c in columns]))
    ranked = placed.filter(cut_through).withColumn("__rank", rank).withColumn("part", part([F.col("__rank") <= F.col(c) for c in cuts]))
    kept = [*[F.col(f"`{c}`") for c in df.columns], F.col("part")]
    return whole.select(*kept).unionByName(ranked.select(*kept))


def train_test(df: DataFrame, target: str, columns: Sequence[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """Add ``part``: test for ceil(share * n) rows, stratified by class; train for the rest."""
    every = F.sum("n").over(Window.partitionBy())
    share_of = quotas(_class_counts(df, target), target, "n", every * share, "__quota").select(F.col(target).alias("__class"), "__quota")
    return _in_parts(df, target, columns, seed, small_side(share_of, "quotas"), ["__quota"], ["test", "train"])


def train_val_test(df: DataFrame, target: str, columns: Sequence[str], holdout: float = 0.4, seed: int = 0) -> DataFrame:
    """Add ``part``: train, val or test; a stratified holdout, then half of it for test."""
    every = Window.partitionBy()
    counts = quotas(_class_counts(df, target), target, "n", F.sum("n").over(every) * holdout, "__held")
    counts = quotas(counts, target, "__held", F.sum("__held").over(every) * 0.5, "__test").select(F.col(target).alias("__class"), "__held", "__test")
    return _in_parts(df, target, columns, seed, small_side(counts, "quotas"), ["__test", "__held"], ["test", "val", "train"])
