"""Feature scores and selection. A scorer returns (feature, idx, score), idx being the column's place."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.splitting import sample_n
from netloom.sources.sinks import stored

Scorer = Callable[[DataFrame, Sequence[str], str], DataFrame]

#: Points of a feature in a range of values.
RANGE_ROWS = 20_000
#: Beyond so many ranges they grow instead.
MOST_RANGES = 2_000
#: Rows of one value and class that are made from one row at a time.
PIECE = 10_000


def melt(df: DataFrame, features: Sequence[str], target: str, kind: str = "double") -> DataFrame:
    """(feature, idx, value, class): one row per feature and row, without a shuffle."""
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"), F.col(c).cast(kind).alias("value")) for i, c in enumerate(features)]
    return df.select(F.col(target).alias("class"), F.inline(F.array(*cells))).select("feature", "idx", "value", "class")


def chi2(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Chi-squared of summed feature values by class against class shares; null where a feature sums to 0."""
    sums = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features])
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"), F.col(c).alias("observed")) for i, c in enumerate(features)]
    tall = sums.select("n", F.inline(F.array(*cells)))
    total = tall.groupBy("feature", "idx").agg(F.sum("n").alias("rows"), F.sum("observed").alias("all"))
    expected = F.col("n") / F.col("rows") * F.nullif(F.col("all"), F.lit(0.0))
    term = (F.col("observed") - expected) ** 2 / expected
    return tall.join(total, ["feature", "idx"]).groupBy("feature", "idx").agg(F.sum(term).alias("score"))


def mi_discrete(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mutual information (nats) of discrete features with the class, from joint counts."""
    joint = melt(df, features, target, "string").groupBy("feature", "idx", "value", "class").agg(F.count(F.lit(1)).alias("n"))
    value, cls, every = (Window.partitionBy(*k) for k in (("feature", "value"), ("feature", "class"), ("feature",)))
    n, total = F.col("n").cast("double"), F.sum("n").over(every)
    part = n / total * F.log(n * total / (F.sum("n").over(value) * F.sum("n").over(cls)))
    return joint.withColumn("part", part).groupBy("feature", "idx").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("score"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for _ in range(6):
        low -= np.where(x < 6, 1 / x, 0)
        x = np.where(x < 6, x + 1, x)
    y = 1 / x**2
    return low + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def knn_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Mutual information of a continuous feature and a class by the k-nearest-neighbour estimate."""
    x = x / (x.std() or 1.0)
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * np.random.default_rng(seed).standard_normal(len(x))
    radius, size, near = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        if len(own) < 2:
            continue
        kk = min(k, len(own) - 1)
        order = own[np.argsort(x[own])]
        v = x[order]
        padded = np.concatenate([np.full(kk, -np.inf), v, np.full(kk, np.inf)])
        # The kk nearest of a sorted line are a window that holds the point: the best of kk + 1 windows.
        reach = [np.maximum(v - padded[j : j + len(v)], padded[j + kk : j + kk + len(v)] - v) for j in range(kk + 1)]
        radius[order] = np.min(reach, axis=0) * (1 - 1e-9)  # without the k-th neighbour itself, whatever the rounding
        size[order], near[order] = len(own), kk
    use = size > 0
    line = np.sort(x[use])
    around = np.searchsorted(line, x[use] + radius[use], "right") - np.searchsorted(line, x[use] - radius[use], "left")
    value = _digamma(np.array([use.sum()]))[0] + _digamma(near[use]).mean() - _digamma(size[use]).mean() - _digamma(around).mean()
    return max(0.0, float(value))


def _digamma_of(x: Column) -> Column:
    """``_digamma`` as an expression, for positive integers."""
    far = x.cast("double") + 6
    y = 1 / far**2
    low = F.lit(0.0)
    for i in range(6):
        low = low + 1 / (x.cast("double") + i)
    return F.log(far) - 0.5 / far - y * (1 / 12 - y * (1 / 120 - y / 252)) - low


def _noise(seed: int) -> Column:
    """A standard normal number for the j-th of the rows with a feature's value and class, whatever their order."""
    even = [(F.shiftrightunsigned(F.xxhash64("idx", "value", "class", "j", F.lit(seed), F.lit(i)), 11) + 0.5) / 2.0**53 for i in range(2)]
    return F.sqrt(-2 * F.log(even[0])) * F.cos(2 * np.pi * even[1])


def _points(df: DataFrame, features: Sequence[str], target: str, k: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(idx, code, x): each value scaled and noised as in ``knn_information``; and (idx, code, size, near): its class's rows and neighbours."""
    tall = melt(df, features, target).withColumn("class", F.col("class").cast("string")).filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("class").isNotNull())
    cells = stored(tall.groupBy("idx", "value", "class").agg(F.count(F.lit(1)).alias("n")), "cells")
    mean = cells.groupBy("idx").agg(F.sum("n").alias("rows"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.abs("value") * F.col("n")) / F.sum("n")).alias("far"))
    spread = cells.join(F.broadcast(mean), "idx").groupBy("idx", "far").agg((F.max("value") > F.min("value")).alias("varies"), F.sqrt(F.sum((F.col("value") - F.col("mean")) ** 2 * F.col("n")) / F.sum("n")).alias("std"))
    spread = spread.withColumn("std", F.when(F.col("varies") & (F.col("std") > 0), F.col("std")).otherwise(1.0)).withColumn("unit", 1e-10 * F.greatest(F.lit(1.0), F.col("far") / F.col("std"))).drop("far", "varies")
    sizes = cells.groupBy("idx", "class").agg(F.sum("n").alias("size")).filter("size > 1").withColumn("near", F.least(F.lit(k).cast("long"), F.col("size") - 1))
    # A row for each feature and class.
    sizes = stored(sizes.withColumn("code", F.row_number().over(Window.partitionBy("idx").orderBy("class"))), "sizes")
    # Equal values are dealt out in pieces, so that no task makes all the rows of a common one.
    pieces = cells.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE)))).repartition("idx", "value", "class", "piece")
    first = F.col("piece") * PIECE
    rows = pieces.withColumn("j", F.explode(F.sequence(first, F.least(F.col("n"), first + PIECE) - 1))).join(F.broadcast(spread), "idx").join(F.broadcast(sizes), ["idx", "class"])
    points = stored(rows.select("idx", "code", (F.col("value") / F.col("std") + F.col("unit") * _noise(seed)).alias("x")), "points")
    return points, sizes.select("idx", "code", "size", "near")


def _bounds(points: DataFrame) -> dict[int, np.ndarray]:
    """Of each feature, points that cut it into ranges of about RANGE_ROWS; a range begins with its bound."""
    most = points.groupBy("idx").count().agg(F.max("count")).first()[0] or 0
    n = min(MOST_RANGES, max(1, -(-most // RANGE_ROWS)))
    if n == 1:
        return {}
    cuts = points.groupBy("idx").agg(F.percentile_approx("x", [i / n for i in range(1, n)], 10 * n).alias("cuts")).collect()
    return {r.idx: np.unique(r.cuts) for r in cuts}


def _range_of(bounds: dict[int, np.ndarray], idx: int, x: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds[idx], x, "right").astype(np.int32) if bounds else np.zeros(len(x), np.int32)


def _packed(points: DataFrame, bounds: dict[int, np.ndarray], k: int) -> DataFrame:
    """A row for each range: its points and their classes, sorted, and each class's count, first k and last k points."""

    @F.pandas_udf("int")
    def place(idx: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int32)
        for i in idx.unique():
            own = (idx == i).to_numpy()
            out[own] = _range_of(bounds, i, x.to_numpy()[own])
        return pd.Series(out)

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame.x.to_numpy(), kind="stable")
        x, codes = frame.x.to_numpy()[order], frame.code.to_numpy(np.int32)[order]
        ends = [(int(c), len(own), own[:k].tolist(), own[-k:].tolist()) for c in np.unique(codes) for own in (x[codes == c],)]
        return pd.DataFrame({"idx": [key[0]], "range": [key[1]], "n": [len(x)], "x": [x.tobytes()], "codes": [codes.tobytes()], "ends": [ends]})

    ends = "array<struct<code: int, n: long, low: array<double>, high: array<double>>>"
    placed = points.withColumn("range", place("idx", "x") if bounds else F.lit(0))
    return stored(placed.groupBy("idx", "range").applyInPandas(pack, f"idx int, range int, n long, x binary, codes binary, ends {ends}"), "ranges")


def _edges(packed: DataFrame, k: int) -> DataFrame:
    """(idx, range, before, edges): the feature's points in earlier ranges, and of each class in the range its neighbours (near) and nearest k points below and above the range."""

    def beside(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("range")
        near = min(k, int(frame.n.sum()) - 1)
        below, above = [np.zeros(0)], [np.zeros(0)]
        for high in frame.high:
            below.append(np.concatenate([below[-1], high])[-k:])
        for low in frame.low[::-1]:
            above.append(np.concatenate([low, above[-1]])[:k])
        return pd.DataFrame({"idx": key[0], "range": frame.range.to_numpy(), "code": key[1], "near": near, "below": below[:-1], "above": above[-2::-1]})

    # A row for each range and class, so at most MOST_RANGES a group.
    tall = packed.select("idx", "range", F.inline("ends"))
    found = tall.groupBy("idx", "code").applyInPandas(beside, "idx int, range int, code int, near int, below array<double>, above array<double>")
    edges = found.groupBy("idx", "range").agg(F.collect_list(F.struct("code", "near", "below", "above")).alias("edges"))
    return edges.join(_offsets(packed), ["idx", "range"])


def _offsets(packed: DataFrame) -> DataFrame:
    before = Window.partitionBy("idx").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("idx", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _counted(packed: DataFrame, bounds: dict[int, np.ndarray], k: int) -> DataFrame:
    """What the ranges know of the points within reach (of any class) of each of their points.

    (idx, range, id, n, others, to, at, upper): where both ends of the window lie in
    the point's range, only the sum of the digammas over n points (id -1). For the
    other points (id) a row with what is known of their count (n), and a row for each
    end in another range (to), up to which points are still to be counted.
    """

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        idx, own = int(key[0]), int(key[1])
        x, codes = np.frombuffer(frame.x[0]), np.frombuffer(frame.codes[0], np.int32)
        reach = np.zeros(len(x))
        for e in frame.edges[0]:
            at = np.flatnonzero(codes == e["code"])
            below, above, kk = np.asarray(e["below"], float), np.asarray(e["above"], float), int(e["near"])
            v = np.concatenate([below, x[at], above])
            padded = np.concatenate([np.full(kk, -np.inf), v, np.full(kk, np.inf)])
            gaps = [np.maximum(v - padded[j : j + len(v)], padded[j + kk : j + kk + len(v)] - v) for j in range(kk + 1)]
            reach[at] = np.min(gaps, axis=0)[len(below) : len(below) + len(at)] * (1 - 1e-9)
        before, known, inside, out = int(frame.before[0]), np.zeros(len(x), np.int64), np.ones(len(x), bool), []
        for sign, ends, side in ((-1, x - reach, "left"), (1, x + reach, "right")):
            to = _range_of(bounds, idx, ends)
            here = to == own
            known += np.where(here, sign * (before + np.searchsorted(x, ends, side)), 0)
            inside &= here
            away = np.flatnonzero(~here)
            out.append(pd.DataFrame({"id": away, "to": to[away], "at": ends[away], "upper": sign > 0}))
        left = np.flatnonzero(~inside)
        total = float(_digamma(known[inside]).sum()) if inside.any() else 0.0
        out += [pd.DataFrame({"id": left, "n": known[left]}), pd.DataFrame({"id": [-1], "n": [int(inside.sum())], "others": [total]})]
        found = pd.concat([o for o in out if len(o)]).reindex(columns=["id", "n", "others", "to", "at", "upper"])
        return found.assign(idx=idx, range=own)[["idx", "range", "id", "n", "others", "to", "at", "upper"]].astype({"n": "Int64", "to": "Int32", "upper": "boolean"})

    rows = packed.drop("n", "ends").join(_edges(packed, k), ["idx", "range"])
    return stored(rows.groupBy("idx", "range").applyInPandas(count, "idx int, range int, id long, n long, others double, to int, at double, upper boolean"), "counted")


def _others(packed: DataFrame, counted: DataFrame) -> DataFrame:
    """(idx, n, others): the sums of the digammas of the points' counts; ends in other ranges are looked up there."""

    def look_up(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, asked = np.frombuffer(frame.x[0]), pd.DataFrame(list(frame.asked[0]))
        at = asked["at"].to_numpy(float)
        upto = int(frame.before[0]) + np.where(asked.upper, np.searchsorted(x, at, "right"), np.searchsorted(x, at, "left"))
        return pd.DataFrame({"idx": key[0], "range": asked["from"], "id": asked["id"], "n": np.where(asked.upper, upto, -upto)})

    asked = counted.filter(F.col("to").isNotNull()).groupBy("idx", F.col("to").alias("range")).agg(F.collect_list(F.struct(F.col("range").alias("from"), "id", "at", "upper")).alias("asked"))
    # Below the first range there is nothing: a range without points has no row and adds nothing.
    rows = packed.select("idx", "range", "x").join(_offsets(packed), ["idx", "range"]).join(asked, ["idx", "range"])
    looked_up = rows.groupBy("idx", "range").applyInPandas(look_up, "idx int, range int, id long, n long")
    known = counted.filter(F.col("to").isNull() & (F.col("id") >= 0)).select("idx", "range", "id", "n")
    around = known.unionByName(looked_up).groupBy("idx", "range", "id").agg(F.sum("n").alias("around"))
    open_ends = around.select("idx", F.lit(1).cast("long").alias("n"), _digamma_of(F.col("around")).alias("others"))
    sums = counted.filter(F.col("id") == -1).select("idx", "n", "others").unionByName(open_ends)
    return sums.groupBy("idx").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))


def mi_continuous(df: DataFrame, features: Sequence[str], target: str, rows: int | None = None, seed: int = 42, k: int = 3) -> DataFrame:
    """Mutual information of continuous features by ``knn_information``'s estimate, over all rows or a sample of at most ``rows``.

    A feature's points are cut into ranges of values, each of a bounded number, and
    shuffled once; a range is a row from there on. What a range needs of others, the
    nearest points of each class beside it and the ends of few windows, is exchanged.
    """
    picked = df.select(*features, target)
    picked = picked if rows is None else sample_n(picked, rows, [*features, target], seed)
    points, sizes = _points(picked, features, target, k, seed)
    bounds = _bounds(points)
    packed = _packed(points, bounds, k)
    others = _others(packed, _counted(packed, bounds, k))
    own = sizes.groupBy("idx").agg(F.sum("size").alias("all"), (F.sum(F.col("size") * (_digamma_of(F.col("near")) - _digamma_of(F.col("size")))) / F.sum("size")).alias("own"))
    score = F.greatest(F.lit(0.0), _digamma_of(F.col("all")) + F.col("own") - F.col("others") / F.col("n"))
    scores = own.join(others, "idx").select("idx", score.alias("score"))
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features)], "feature string, idx int")
    return every.join(scores, "idx", "left").select("feature", "idx", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best scores (null worst; of equal ones, the later columns), in column order."""
    best = scores.orderBy(F.col("score").desc_nulls_last(), F.col("idx").desc()).limit(k)
    return best.orderBy("idx")


def select_k_best(df: DataFrame, features: Sequence[str], target: str, k: int = 25, scorer: Scorer = chi2) -> list[str]:
    return [r.feature for r in top_k(scorer(df, features, target), min(k, len(features))).collect()]


def stable_features(df: DataFrame, features: Sequence[str], target: str, top: int = 30, runs: int = 3, least: int = 2, rows: int = 200_000) -> DataFrame:
    """(feature, idx, votes): features among the ``top`` of at least ``least`` sampled runs; all if there are none."""
    every = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(features)], "feature string, idx int")
    picks = None
    for run in range(runs):
        own = top_k(mi_continuous(df, features, target, rows, 42 + run), min(top, len(features))).select("feature")
        picks = own if picks is None else picks.union(own)
    votes = every.join(picks.groupBy("feature").agg(F.count(F.lit(1)).alias("votes")), "feature", "left").fillna(0, "votes")
    any_kept = F.max("votes").over(Window.partitionBy()) >= least
    return votes.withColumn("any", any_kept).filter((F.col("votes") >= least) | ~F.col("any")).select("feature", "idx", F.col("votes").cast("long").alias("votes"))
