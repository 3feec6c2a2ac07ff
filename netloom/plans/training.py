"""The preparation of training data from flows, end to end, as lazy steps with fitted tables between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import columns as C
from netloom.operators import encoding, filters, projection, scaling, selection, splitting
from netloom.sources.sinks import stored


@dataclass
class Fitted:
    """What was learnt from the training part: dictionaries, ranges and the chosen features."""

    categorical: list[str]
    numeric: list[str]
    logged: list[str]
    dictionaries: dict[str, DataFrame]
    ranges: DataFrame
    final_ranges: DataFrame
    features: list[str]
    classes: DataFrame
    unknown: str | None = None


def _coded(df: DataFrame, f: Fitted, keep: Sequence[str]) -> DataFrame:
    """Padded, cleaned rows with codes in place of categories."""
    fill = {c: F.lit(C.MISSING) for c in f.categorical} | {c: F.lit(0.0) for c in f.numeric}
    out = df.withColumns({c: v for c, v in fill.items() if c not in df.columns})
    out = projection.clean_features(out, f.categorical, f.numeric, f.logged, keep)
    apply = encoding.apply_codes if f.unknown is None else encoding.apply_codes_with_unknown
    for c in f.categorical:
        out = apply(out, c, f.dictionaries[c], f"{c}__code").drop(c).withColumnRenamed(f"{c}__code", c)
    return out


def prepare(
    flows: DataFrame, target: str, columns: Sequence[str], categorical: Sequence[str] | None = None, logged: Sequence[str] = (),
    excluded: Sequence[str] = (), rare: int = 3, k: int = 25, scorer: selection.Scorer = selection.chi2, unknown: str | None = None, seed: int = 0,
) -> tuple[DataFrame, Fitted]:
    """(rows with part, code and scaled features; what was fitted on the training part).

    Each fit is one job whose small table is stored; the split is stored as well. Steps: trim headers, drop time and topology, leave out classes, clean, split
    60/20/20, encode, scale, select, scale again. ``columns`` order the split's hash.
    """
    df = filters.require_columns(projection.strip_header(flows), [target])
    df = projection.drop_topology(projection.drop_time(df))
    df = filters.drop_rare_classes(filters.exclude_classes(df, target, excluded), target, rare)
    split = stored(splitting.train_val_test(df, target, [c for c in columns if c in df.columns], seed=seed), "split")
    inputs = [c for c in df.columns if c != target]
    cats, nums = projection.split_columns(df.select(*inputs), categorical) if categorical is not None else projection.split_columns_by_type(df.select(*inputs))
    train = split.filter("part = 'train'")
    clean = projection.clean_features(train, cats, nums, logged)
    fit_codes = encoding.fit_codes if unknown is None else encoding.fit_codes_with_unknown
    fitted = Fitted(cats, nums, [c for c in logged if c in nums], {c: stored(fit_codes(clean, c), "codes") for c in cats}, None, None, [], stored(encoding.fit_classes(train, target), "classes"), unknown)
    # Stored: texts are read as numbers once, not for each fit.
    coded = stored(_coded(train, fitted, [target]), "coded")
    fitted.ranges = stored(scaling.fit_min_max(coded, nums), "ranges") if nums else None
    scaled = scaling.apply_min_max(coded, nums, fitted.ranges) if nums else coded
    every = [*cats, *nums]
    fitted.final_ranges = stored(scaling.fit_min_max(scaled, every), "ranges")
    fitted.features = selection.select_k_best(scaling.apply_min_max(scaled, every, fitted.final_ranges), every, target, k, scorer)
    return transform(split, fitted, target, keep=["part"]), fitted


def transform(df: DataFrame, fitted: Fitted, target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Apply fitted tables to any rows: missing columns are padded, unknown categories get the unknown code."""
    filters.require_columns(df, keep)
    rows = df if target in df.columns else df.withColumn(target, F.lit(None).cast("string"))
    out = _coded(rows.withColumn("__keep", F.struct(F.lit(0).alias("none"), *keep)), fitted, ["__keep", target])
    if fitted.numeric:
        out = scaling.apply_min_max(out, fitted.numeric, fitted.ranges)
    out = scaling.apply_min_max(out, [*fitted.categorical, *fitted.numeric], fitted.final_ranges)
    out = encoding.apply_codes(out, target, fitted.classes, "class_code", F.lit(-1))
    return out.select(*[f"__keep.{c}" for c in keep], target, "class_code", *[f"`{c}`" for c in fitted.features])
