"""Binary and multi-class evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8


def binary_counts(df: DataFrame, truth: str, predicted: str, *more: Column) -> DataFrame:
    """One row: tp, tn, fp, fn, and ``more`` aggregates of the same pass."""
    t, p = F.col(truth), F.col(predicted)
    return df.agg(*[F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))], *more)


def binary_metrics(df: DataFrame, truth: str, predicted: str, *more: Column) -> DataFrame:
    """One row: the counts, accuracy, precision, recall, fpr and fnr (denominators plus 1e-8), and ``more`` aggregates."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rate = lambda a, b: a / (b + EPSILON)
    found = binary_counts(df, truth, predicted, *more)
    return found.select(
        "tp", "tn", "fp", "fn", ((tp + tn) / F.greatest(tp + tn + fp + fn, F.lit(1))).alias("accuracy"),
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(fp, fp + tn).alias("fpr"), rate(fn, fn + tp).alias("fnr"), *found.columns[4:],
    )


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(truth, predicted, n) over all pairs of ``classes`` (one column, class), zero cells too."""
    pairs = classes.select(F.col("class").alias("truth")).join(F.broadcast(classes.select(F.col("class").alias("predicted"))), how="cross")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, ["truth", "predicted"], "left").fillna(0, "n")


def classification_report(df: DataFrame, truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support): a row per class, then accuracy, macro avg and weighted avg.

    A ratio with nothing below the line is 0. For accuracy, all three ratios are the accuracy.
    """
    cells = confusion_matrix(df, truth, predicted, classes)
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = cells.groupBy(F.col("truth").cast("string").alias("label")).agg(F.sum(hit).alias("tp"), F.sum("n").alias("support"))
    said = cells.groupBy(F.col("predicted").cast("string").alias("label")).agg(F.sum("n").alias("said"))
    rows = rows.join(said, "label")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = rows.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    per_class = rows.select("label", *names, "support")
    accuracy = rows.agg(ratio(F.sum("tp"), F.sum("support")).alias("a"), F.sum("support").alias("support")).select(F.lit("accuracy").alias("label"), *[F.col("a").alias(c) for c in names], "support")
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("label"), *names, "support")
    weighted = rows.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("label"), *names, "support")
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def with_prediction_confidence(df: DataFrame, probabilities: str) -> DataFrame:
    """Add predicted (the likeliest class) and confidence."""
    p = F.col(probabilities)
    return df.withColumns({"predicted": (F.array_position(p, F.array_max(p)) - 1).cast("int"), "confidence": F.array_max(p)})


def class_domain(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(class): the sorted distinct values of several columns."""
    every = None
    for df, name in columns:
        own = df.select(F.col(name).alias("class"))
        every = own if every is None else every.union(own)
    return every.distinct()


def with_share(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share)."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
