"""Mixing sources to target weights, in native column expressions.

A source's target is its weight's share of all words; a target stops at
``limit`` times its source's words and the excess goes to the others by weight.
A document is emitted floor(rate) times plus one hash-seeded copy with
probability equal to the fraction, rate being target / words of its source. The
coin hashes the whole row (id, source, text) and its number among equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import common

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-2"
#: Tasks that repeats of one row are dealt over.
SALTS = 64


def n_words(text: Column) -> Column:
    return F.size(common.words_of(text)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row per source, null last.

    The sources are few beside the documents, so their windows run in one task.
    """
    totals = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    totals = totals.select("source", "source_size", rank.alias("rank"), weight.cast("double").alias("weight"))
    cap = F.col("source_size") * limit
    # Sources fill up in the order of cap / weight; one that fills before the common level is reached is full.
    order = Window.orderBy(cap / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onwards = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    totals = totals.withColumn("all", F.sum("source_size").over(everything))
    totals = totals.withColumn("level", (F.col("all") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onwards))
    totals = totals.withColumn("full", cap <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full"), cap.cast("double")).otherwise(F.least(level * F.col("weight"), cap.cast("double")))
    return totals.select("source", "source_size", target.alias("target"))


def draw_key(docs: DataFrame) -> Column:
    """A hash of id, source and text; rows that agree in all three share it."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", part("doc_id"), part("source"), part("text")).cast("binary"))


def _numbered(keyed: DataFrame) -> DataFrame:
    """Add ``number``: 1, 2, ... within rows of one ``key``, so that each repeat tosses a coin of its own.

    Only repeated rows are numbered, dealt over SALTS tasks for each key; the rest have 1.
    """
    repeated = common.materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated-keys")
    if repeated.isEmpty():
        return keyed.withColumn("number", F.lit(1).cast("long"))
    few = common.maybe_broadcast(repeated)
    again = common.materialize(keyed.join(few, "key", "left_semi").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "repeats")
    sums = again.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = common.materialize(sums.select("key", "salt", before.alias("before")), "offsets")
    own = F.row_number().over(Window.partitionBy("key", "salt").orderBy("key"))
    again = again.withColumn("own", own).join(common.maybe_broadcast(offsets), ["key", "salt"])
    again = again.withColumn("number", F.col("before") + F.col("own")).drop("salt", "own", "before")
    return keyed.join(few, "key", "left_anti").withColumn("number", F.lit(1).cast("long")).unionByName(again)


def with_copies(docs: DataFrame, targets: DataFrame, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """Add source_size, target and copies (how often the mix takes the row) to rows of (source, key, ...), key being their ``draw_key``."""
    targets = targets.withColumnsRenamed({"source": "__source"})
    docs = _numbered(docs)
    joined = docs.join(common.maybe_broadcast(targets), docs["source"].eqNullSafe(targets["__source"]), "left").drop("__source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(F.lit(0.0))
    coin = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "key", F.col("number").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    return joined.withColumn("copies", (F.floor(rate) + (coin < rate - F.floor(rate)).cast("long")).cast("long")).drop("key", "number")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken (words the mix takes).

    Null and empty texts have size 0; the null source is a source of its own;
    every row tosses its own coin, rows with equal or null ids and repeated rows
    too; sources without words have target 0. An empty table gives no rows.
    Columns besides doc_id, source and text are not read.
    """
    sizes = common.materialize(docs.select("doc_id", "source", draw_key(docs).alias("key"), n_words(F.col("text")).alias("size")), "sizes")
    mixed = with_copies(sizes, common.materialize(source_targets(sizes), "targets"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with the columns of ``docs``, whatever their names."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = common.materialize(source_targets(sizes, weights, limit), "targets")
    mixed = with_copies(docs.select(F.struct("*").alias("row"), "source", draw_key(docs).alias("key")), targets, limit, seed)
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
