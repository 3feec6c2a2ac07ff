"""Category dictionaries: fitted as tables, applied by joins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.ranking import with_rank

UNKNOWN = "__UNK__"
#: Dictionaries of at most so many entries are broadcast.
BROADCAST_ENTRIES = 100_000


def _codes(values: DataFrame, value: str, first: int) -> DataFrame:
    values = values.select(F.col(value).alias("value")).filter(F.col("value").isNotNull()).distinct()
    # What all values begin with (such as a scheme or a network) tells none of them apart: buckets follow the characters behind it.
    ends = values.agg(F.min("value").cast("string").alias("low"), F.max("value").cast("string").alias("high")).first()
    shared = len(os.path.commonprefix([ends.low or "", ends.high or ""]))
    ranked = with_rank(values, F.substring(F.col("value").cast("string"), shared + 1, 2), [F.col("value")], name="code")
    return ranked.select("value", (F.col("code") - 1 + first).cast("int").alias("code"))


def fit_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code): sorted distinct values from 1 on; 0 is for unknown ones."""
    return _codes(train.select(F.col(column).cast("string").alias("v")), "v", 1)


def fit_codes_with_unknown(train: DataFrame, column: str, unknown: str = UNKNOWN) -> DataFrame:
    """(value, code): sorted distinct values from 0 on, the unknown mark among them in its place."""
    marked = train.select(F.col(column).cast("string").alias("v")).union(train.sparkSession.createDataFrame([(unknown,)], "v string"))
    return _codes(marked, "v", 0)


def fit_classes(train: DataFrame, target: str) -> DataFrame:
    """(value, code) of a target: sorted distinct classes from 0 on."""
    return _codes(train.select(F.col(target).cast("string").alias("v")), "v", 0)


def _joined(df: DataFrame, column: str, dictionary: DataFrame, how: str = "left") -> DataFrame:
    side = dictionary.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    side = F.broadcast(side) if dictionary.count() <= BROADCAST_ENTRIES else side
    return df.join(side, df[column].cast("string") == F.col("__value"), how)


def apply_codes(df: DataFrame, column: str, dictionary: DataFrame, to: str, default: Column | None = None) -> DataFrame:
    """Add ``to``: the code of ``column``, ``default`` (0) for values that the dictionary lacks."""
    code = F.coalesce("__code", F.lit(0) if default is None else default).cast("int")
    return _joined(df, column, dictionary).withColumn(to, code).drop("__value", "__code")


def apply_codes_with_unknown(df: DataFrame, column: str, dictionary: DataFrame, to: str, unknown: str = UNKNOWN) -> DataFrame:
    """Add ``to``: the code of ``column``, or that of the unknown mark."""
    code = dictionary.filter(F.col("value") == unknown).first().code
    return apply_codes(df, column, dictionary, to, F.lit(code))


def decode(df: DataFrame, column: str, dictionary: DataFrame, to: str) -> DataFrame:
    """Add ``to``: the value that a code stands for."""
    names = dictionary.select(F.col("value").alias(to), F.col("code").alias("__code"))
    return df.join(F.broadcast(names) if dictionary.count() <= BROADCAST_ENTRIES else names, df[column] == F.col("__code"), "left").drop("__code")
