"""Column-level steps: headers, dropping, restricting and padding columns, feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions import columns as C

# Columns that carry time or topology, and the names a label may have, best first.
TIME_COLUMNS = ("ts", "date", "time")
TOPOLOGY_COLUMNS = ("src_ip", "dst_ip", "srcip", "dstip")
LABEL_NAMES = ("label", "Label", "type")


def strip_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_time(df: DataFrame) -> DataFrame:
    return df.drop(*TIME_COLUMNS)


def drop_label(df: DataFrame) -> DataFrame:
    return df.drop("label")


def drop_topology(df: DataFrame, drop: bool = True, label: bool = False) -> DataFrame:
    return df.drop(*TOPOLOGY_COLUMNS, *(["label"] if label else [])) if drop else df


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Without text columns, but for those in ``keep``."""
    return df.select(*[f"`{f.name}`" for f in df.schema if f.name in keep or not isinstance(f.dataType, T.StringType)])


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def restrict(df: DataFrame, features: Sequence[str], shown: int = 25) -> DataFrame:
    """The features in list order; an error names up to ``shown`` missing ones."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} features are missing: {missing[:shown]}")
    return df.select(*[f"`{c}`" for c in features])


def pad(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """All required columns in order, each once; a missing one is filled with ``missing`` or 0."""
    wanted = list(dict.fromkeys([*categorical, *numeric]))
    fill = lambda c: F.lit(C.MISSING) if c in categorical else F.lit(0.0)
    return df.select(*[F.col(f"`{c}`") if c in df.columns else fill(c).alias(c) for c in wanted])


def label_column(df: DataFrame, names: Sequence[str] = LABEL_NAMES) -> str:
    """The first of ``names`` that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no label column among {list(names)}")


def rename_label(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("Label", "label")


def split_columns(df: DataFrame, categorical: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical, numeric) by a list of names: what isn't listed is numeric."""
    own = [c for c in categorical if c in df.columns]
    return own, [c for c in df.columns if c not in own]


def split_columns_by_type(df: DataFrame, all_categorical: bool = False) -> tuple[list[str], list[str]]:
    """(categorical, numeric) by type: text is categorical. all_categorical: so is everything, as for untyped input."""
    own = [f.name for f in df.schema if all_categorical or isinstance(f.dataType, T.StringType)]
    return own, [c for c in df.columns if c not in own]


def downcast(df: DataFrame) -> DataFrame:
    """float for double and int for bigint, at the border to a model."""
    to = {T.DoubleType(): "float", T.LongType(): "int"}
    return df.select(*[F.col(f"`{f.name}`").cast(to[f.dataType]).alias(f.name) if f.dataType in to else F.col(f"`{f.name}`") for f in df.schema])


def vector(features: Sequence[str]) -> Column:
    """Features as one float array."""
    return F.array(*[F.col(f"`{c}`").cast("float") for c in features])


def sequence_of(values: Column) -> Column:
    """A feature array as a sequence of one time step."""
    return F.array(values)


def tokens_of(values: Column) -> Column:
    """A feature array as a sequence of one-channel tokens."""
    return F.transform(values, lambda x: F.array(x))


def clean_features(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], logged: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Clean categoricals; numbers coerced, made finite and, where listed, logged. ``keep`` passes through. One projection."""
    # Doubles and whole numbers are what their text would be read as.
    plain = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.IntegralType))}
    number = lambda c: C.finite_or_zero(F.col(f"`{c}`").cast("double") if c in plain else C.to_number(F.col(f"`{c}`")))
    made = [C.clean_categorical(F.col(f"`{c}`")).alias(c) for c in categorical]
    made += [(C.log1p_clipped(number(c)) if c in logged else number(c)).alias(c) for c in numeric]
    return df.select(*[f"`{c}`" for c in keep], *made)
