"""Column scaling: one aggregation fits all columns, one projection applies it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import columns as C


def fit_min_max(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: <feature>_min and <feature>_max of every feature."""
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("min", F.min), ("max", F.max))])


def apply_min_max(df: DataFrame, features: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Scale to the fitted range; a constant column becomes 0, values outside are not cut."""
    keep = [c for c in df.columns if c not in features]
    scaled = [C.min_max(F.col(c).cast("double"), F.col(f"{c}_min"), F.col(f"{c}_max")).alias(c) for c in features]
    return df.join(F.broadcast(fitted), how="cross").select(*keep, *scaled)


def fit_z(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: <feature>_mean and <feature>_sd (of the population) of every feature."""
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def apply_z(df: DataFrame, features: Sequence[str], fitted: DataFrame) -> DataFrame:
    keep = [c for c in df.columns if c not in features]
    scaled = [C.z_score(F.col(c).cast("double"), F.col(f"{c}_mean"), F.col(f"{c}_sd")).alias(c) for c in features]
    return df.join(F.broadcast(fitted), how="cross").select(*keep, *scaled)
