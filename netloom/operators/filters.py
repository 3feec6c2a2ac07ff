"""Row filters and the guards that stop a run early."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.sources.sinks import small_side


def exclude_classes(df: DataFrame, target: str, classes: Sequence[str]) -> DataFrame:
    """Without the listed classes; a null class stays."""
    c = F.col(target)
    return df.filter(c.isNull() | ~c.isin(*classes))


def drop_rare_classes(df: DataFrame, target: str, least: int = 3) -> DataFrame:
    """Without classes of fewer than ``least`` rows. Rows stay where they are: dealt by class, the largest class would be one task, here and in each later step."""
    rare = df.groupBy(target).count().filter(F.col("count") < least).select(F.col(target).alias("__rare"))
    return df.join(small_side(rare, "rare"), df[target].eqNullSafe(F.col("__rare")), "left_anti")


def trailing(df: DataFrame, ts: str, now: Column, window: str = "24 hours") -> DataFrame:
    """Rows of the window before ``now``, both ends included below it; a null time is out."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {window}"))


def within_ttl(last: Column, now: Column, window: str = "24 hours") -> Column:
    """Whether a state is fresh; one without a time is."""
    return F.coalesce(now - last < F.expr(f"INTERVAL {window}"), F.lit(True))


def above(probability: Column, threshold: float = 0.5) -> Column:
    """1 strictly above the threshold."""
    return (probability > threshold).cast("int")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unseen_classes(train: DataFrame, other: DataFrame, target: str) -> DataFrame:
    """The classes of ``other`` that ``train`` doesn't have."""
    return other.select(target).distinct().join(train.select(target).distinct(), target, "left_anti")


def require_seen_classes(train: DataFrame, other: DataFrame, target: str) -> None:
    unseen = sorted(str(r[0]) for r in unseen_classes(train, other, target).take(50))
    if unseen:
        raise ValueError(f"classes that training doesn't have: {unseen}")


def require_classes(df: DataFrame, target: str) -> None:
    """A null class is an error: it would train as a class of its own."""
    if not df.filter(F.col(target).isNull()).isEmpty():
        raise ValueError(f"{target} has nulls")
